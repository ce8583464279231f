"""Documents in which template fields, filler, error messages or script notices stand in place of content.

Method: the normalised lines of all documents are counted by host (the column ``source``). Lines
that recur on a host are its furniture; they are subtracted, and what is left of a document is
judged: evidence in a line of its own excludes the document. Evidence in a recurrent line is
furniture too where the residual holds content, and stands where nothing else is left of the page.
One pass over each whole text gives both the lines and the evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq
from re import _constants as sre_constants, _parser as sre_parser

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trialspan.llm.shares import share_bound
from trialspan.runtime import cut

#: a line recurs on a host if such a share of its other documents have it, by the lower Wilson bound,
#: so that a host of any size is judged alike
RECURS_SHARE = 0.02
#: so many words in lines that neither recur nor hold evidence are content; so is a line that recurs, but is a
#: closed passage of as many words: a copied text, no furniture
CONTENT_WORDS = 40
#: a recurrent line stands beside content if such a share of the documents that have it hold content
BESIDE_CONTENT = 0.8

# Phrases of error, refusal and script notices by language.
_EN_THING = r"(?:(?:the|that|this|your|a) )?(?:study |session |participant |results? |web )?(?:page|file|record|table|view|log|link|document|resource|article|content|address|url|session|sign-in|account)(?: you (?:asked for|requested|are looking for))?"
_EN_LOST = r"(?:could not be (?:found|loaded|opened|shown|displayed)|cannot be (?:shown|displayed|found|loaded|opened)|can(?:no|')t be (?:found|shown|displayed)|no longer exists?|does not exist|is (?:currently |temporarily )?(?:not |un)available|(?:has )?failed to (?:load|open)|(?:was|has been) (?:moved|removed|deleted)(?: or (?:moved|removed|deleted))?|has expired|has run out|has timed out)"
_EN_SERVICE = r"(?:our|the|this) (?:[a-z]+ )?(?:service|database|server|store|host|site|system)"
_EN_DOWN = r"(?:is (?:down|over capacity|overloaded|busy|offline|unavailable|not responding|under maintenance)|did not (?:answer|respond) in time|did not respond|returned no data|refused the connection|timed out|is currently)"
_HEAD = r"(?:unexpected error|internal (?:server )?error|access denied|forbidden|not found|bad gateway|gateway time-?out|service unavailable|session expired|sign-?in (?:needed|required)|login required|(?:http|status|error|erro|fehler|错误)[ :]*(?:code )?[1-5]\d\d|error inesperado|acceso denegado|sesión caducada|erro inesperado|acesso negado|sessão expirada|zugriff verweigert|unerwarteter fehler|interner fehler|sitzung abgelaufen|[1-5]\d\d (?:gone|forbidden|not found|bad gateway|internal server error|service unavailable|gateway time-?out)|出错了|访问被拒绝|拒绝访问|会话已过期|未找到页面)"
ERRORS = [
    rf"\b{_EN_THING} {_EN_LOST}", rf"\b{_EN_SERVICE} {_EN_DOWN}",
    r"\byou (?:do not|don't) have (?:permission|access|the rights?)\b", r"\bthis (?:area|page|part|section) is (?:only )?for (?:registered|signed-in|authori[sz]ed)\b",
    r"\bprove (?:that )?you(?: are|'re) (?:human|not a robot)", r"\bthe security check (?:did not|failed|could not)", r"\btoo many requests\b", r"\bplease (?:log|sign) in (?:again|first|to)\b",
    rf"(?m)^[\W_]*{_HEAD}[\W_]*$", rf"(?m)^[\W_]*{_HEAD}\s*[:\-–—.!]",
    r"(?m)^[\W_]*(?:page not found|página no encontrada|página não encontrada|seite nicht gefunden|找不到页面)[\W_]*$",
    r"(?m)^[\W_]*(?:uncaught )?(?:traceback|exception(?: in)?|fatal(?: error)?|warning|notice|stack trace)\b[^\n]{0,100}?(?:->|\(\)|_query|line \d+|failed|could not|refused)",
    r"\b(?:la página|el archivo|el (?:registro|documento|recurso|enlace)(?: de la sesión)?|la (?:vista|tabla|sesión)(?: (?:del?|de la) [a-zñáéíóú]+)?|su (?:sesión|enlace)) (?:ya no existe|no existe|no se pudo (?:cargar|abrir|mostrar|encontrar)|no se ha (?:podido )?(?:encontrado|encontrar|cargar|cargado)|no está disponible|se ha movido|ha caducado|ha expirado)",
    r"\bha ocurrido un (?:fallo|error)\b", r"\bdemasiadas peticiones\b", r"\bno tiene permisos?\b", r"\bel servidor no (?:respondió|responde|ha respondido)\b", r"\bdemuestre que es (?:una persona|human[oa])",
    r"\b(?:o registo|o registro|a página|o ficheiro|o arquivo|a vista|a tabela|a sua sessão|a sessão|a ligação) (?:já não existe|não existe|não foi encontrad[oa]|não está disponível|não pôde ser|expirou|foi movid[oa])", r"\bnão tem permissão\b", r"\bo servidor não respond", r"\bdemasiados pedidos\b", r"\bocorreu um erro\b",
    r"\b(?:der eintrag|die seite|die datei|das protokoll|die sitzung|die ansicht|die tabelle|(?:der|ihr) link) (?:existiert nicht(?: mehr)?|wurde nicht gefunden|ist (?:derzeit |zurzeit )?nicht verfügbar|konnte nicht (?:geladen|gefunden|angezeigt) werden|wurde (?:verschoben|gelöscht)|ist abgelaufen)", r"\bzu viele anfragen\b", r"\b(?:keine|nicht die) berechtigung\b", r"\bder server (?:antwortet|hat) nicht\b", r"\bes ist ein fehler aufgetreten\b",
    r"(?<![“”«„\"「『])(?:找不到该?页面|该?页面不存在|该?(?:文件|记录|页面)(?:不存在|已(?:被)?(?:移动|删除)|无法(?:显示|加载))|服务器没有响应|请稍后再试|没有权限|您无权|请求过(?:多|于频繁)|会话已过期)",
]
SCRIPTS = [
    r"<noscript", r"(?m)(?:\b(?:please|must|need to|to go on,|to continue,|cannot start:|^[\W_]*)) ?(?:enable|turn on|switch on|allow|activate|unblock) (?:java)?scripts?\b",
    r"(?m)(?:^|[.!?:>…]\s*|\bthat )(?:java)?scripts? (?:is|are|seems?(?: to be)?|appears? to be|has been) (?:currently )?(?:required|disabled|blocked|needed|turned off|switched off|off|not (?:enabled|supported|available))", r"\byour browser (?:does not|doesn't|cannot) (?:support|run) (?:java)?scripts?",
    r"(?m)(?:\b(?:por favor|aviso|para continuar|debe|atenção|atención|hay que|é preciso)[:,]? |^[\W_]*)(?:habilite|active|activar|permita|habilitar|ative|ativar|desbloquee) (?:el |o |los |os )?(?:javascript|scripts?)",
    r"\b(?:bitte|hinweis)\b[^.\n]{0,30}\b(?:javascript|skripte|scripts)\b[^.\n]{0,25}\b(?:aktivieren|zulassen|erlauben|einschalten)", r"请(?:先)?(?:启用|允许|开启|打开)\s*(?:javascript|脚本)",
]
FILLER = [
    r"\blorem ipsum\b", r"\btext to be (?:added|written|supplied)(?: here| later)?\b", r"\b(?:goes|go) (?:here|in this box)\b", r"\badd (?:\w+ ){1,4}sentences? (?:about|on|here)\b", r"\b(?:replace|delete) this (?:text|paragraph)\b", r"\bplaceholder text\b",
    r"\btexto de relleno\b", r"\bpendiente de (?:redactar|escribir)\b", r"\b(?:escriba|inserte|añada) (?:aquí|su texto)\b", r"\ba preencher (?:pela|pelo|por|aqui)\b", r"\btexto a (?:inserir|preencher)\b", r"\bhier (?:einfügen|einsetzen|eintragen)\b", r"\b(?:blindtext|platzhaltertext)\b", r"示例文字|待补充|此处(?:填写|输入|插入)|占位文字",
    r"\b([^\W\d_]{2,14})(?:[ ,]+\1\b){5,}", r"([一-鿿]{2,8})\1{3,}",
    r"(?:(?:^|(?<=[.!?\n]))\s*(?:[^\W\d_]{4,}[ ,]+){2,}[^\W\d_]{4,}[.!?](?=\s|$)){2}",
]
#: a page built of such lines alone is filler; one of them may be a real heading
HEADINGS = r"(?m)^[\W_]*(?:heading|subtitle|caption|title|your (?:text|title|name)|titel|título|untertitel|subtítulo|insert (?:figure|image|text|table|caption)|(?:subtitle|caption|title|text|heading)(?: goes)? here|标题|正文)[\W_]*$"

_NAME = r"[^\W\d_][\w .\-]{0,40}"
_FIELD_WORD = r"(?:(?:participant|first|last|study|session|reward|deck|n)?[ _]?(?:name|title|date|total|label|trials)|site|sede|local|standort|nombre|nome|vorname|nachname|datum|fecha|data|姓名|日期|地点)"
_SNAKE = r"[^\W\d_]+(?:_[^\W_]+)+"
# Marks that a field of a template leaves, and words that stand for a missing value.
FIELDS = [
    rf"(?<!`)\{{\{{[#/^>]?\s*{_NAME}\}}\}}(?!`)", rf"\[\[\s*{_NAME}\]\]", rf"[$#]\{{\s*{_NAME}\}}", rf"<%[=-]?\s*{_NAME}%>", rf"%\({_NAME}\)[sdf]?", r"%[^\W\d_][^\W\d]{1,40}(?: [^\W\d]{1,20})?%", rf"\${_SNAKE}\b\$?", r"\$[^\W\d_]{3,40}(?: [^\W\d_]{1,20})?\$",
    rf"__{_FIELD_WORD}__", rf"\{{{_FIELD_WORD}\}}", rf"«{_FIELD_WORD}»", rf"&lt;{_FIELD_WORD}&gt;",
    rf"__{_SNAKE}__", rf"\{{{_SNAKE}\}}", rf"\[{_SNAKE}\]", rf"(?<!<)<{_SNAKE}>", rf"«{_SNAKE}»", rf"&lt;{_SNAKE}&gt;",
    r"\[insert\s[^\]\n]{1,60}\]", r"\[[^\]\n]{1,60}\shere\]", r"\[object object\]", r"#(?:ref|value|name|num|null|div/0)[!?]|#n/a\b", r"\(null\)",
]
_UNIT = r"(?:minutes?|minutos?|minuten?|points?|puntos?|pontos?|punkten?|trials?|ensayos?|ensaios?|durchgängen?|rounds?|rondas?|rodadas?|runden?|sessions?|sesion(?:es)?|sessões|sitzungen?|participants?|participantes?|teilnehmern?|seconds?|segundos?|sekunden?|hours?|horas?|stunden?|days?|d[íi]as?|tagen?|euros?|dollars?)"
_GREETING = r"(?:dear|hello|hi|thank you,|thanks,|estimad[oa](?:/[oa])?|hola|gracias,|querid[oa](?:/[oa])?|car[oa](?:/[oa])?|obrigad[oa],|olá|liebe[rs]?(?:/r)?|danke,|hallo|sehr geehrte[rs]?)"
_NO_WORD = r"(?:null|undefined|nan|none|n/a|nil|todo|tbd)"
_NO_SIGN = r"(?:\d*x{3,}|_{2,})"
_OPEN, _CLOSE = r"(?:\{|\[|<|«|&lt;|__)", r"(?:\}|\]|>|»|&gt;|__)"
_FILLABLE = rf"{_OPEN}(?:{_FIELD_WORD}|\d){_CLOSE}"
_PLACE = r"(?:at|in|on|en|em|bei|am)"
_BEHIND_PLACE = r"(?=[ \t]*(?:[.,;:!?]|$)|[ \t]+(?:is|was|are|were|has|had|ran|took|began|started|ended|lasted|fue|es|era|duró|empezó|terminó|foi|é|durou|começou|terminou|ist|war|wurde|begann|endete|dauerte)\b)"
#: places where a value must stand: before a unit, behind a greeting, behind a preposition of place before a verb or the end, between wide characters
SLOTS = [
    *[rf"(?<![\w`]){value} {_UNIT}\b" for value in (_NO_WORD, _NO_SIGN, _SNAKE)], rf"(?<!<){_FILLABLE} {_UNIT}\b",
    *[rf"\b{_GREETING} {value}[ \t]*(?:[,:!]|$)" for value in (_NO_WORD, _NO_SIGN, _SNAKE, _FIELD_WORD, rf"{_OPEN}[^\n{{}}\[\]<>«»&]{{1,60}}{_CLOSE}")],
    *[rf"\b{_PLACE} {value}{_BEHIND_PLACE}" for value in (_NO_WORD, _NO_SIGN, _SNAKE, _FILLABLE)],
    *[rf"(?<=[一-鿿])(?<![为是成作]){value}(?=[一-鿿])" for value in (_NO_WORD, _NO_SIGN, _SNAKE, _FILLABLE)],
]

_FILLER = [re.compile(p, re.I | re.M) for p in FILLER]
_HEADING = re.compile(HEADINGS, re.I)
_SLOT = [re.compile(p, re.I | re.M) for p in SLOTS]
_CODE = re.compile(r"`[^`\n]{1,200}`")

_MOST = 4000
# how rare a character is, about, as a number of common letters
_RARE = {" ": 0.5} | dict.fromkeys("jkqwxyz", 2.0)


def folded(text: str) -> str:
    """Lower case, with the letters that match i and s where case does not count, but have another lower case."""
    if not text.isascii():
        text = text.replace("İ", "i").replace("ı", "i").replace("ſ", "s")
    return text.lower()


def required(pattern: str) -> frozenset[str] | None:
    """Strings, folded, of which any match of ``pattern`` holds at least one; None if there are no such strings.

    Derived from the parsed expression: an alternation needs those of each branch, a sequence the
    best of its parts, where runs of fixed characters are put together.
    """
    found = _needed(list(sre_parser.parse(pattern, re.I | re.M)))
    return found if found and min(map(len, found)) >= 1 else None


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    worth = lambda x: (min(min(sum(_RARE.get(c, 1.0 if c.isalpha() and c < "\u0100" else 4.0) for c in w) for w in x), 8.0), -len(x)) if x else (0, 0)
    return a if worth(a) >= worth(b) else b


def _needed(items: list) -> frozenset[str] | None:
    best, runs = None, frozenset([""])
    for op, arg in items:
        exact = _exact(op, arg)
        if exact is not None and len(runs) * len(exact) <= _MOST:
            runs = frozenset(x + y for x in runs for y in exact)
            continue
        best, runs = _better(best, runs - {""} if "" not in runs else None), frozenset([""])
        inner = None
        if op is sre_constants.SUBPATTERN:
            inner = _needed(list(arg[3]))
        elif op is sre_constants.BRANCH:
            each = [_needed(list(x)) for x in arg[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[0]:
            whole = _all_of(arg[2])
            inner = frozenset(x * arg[0] for x in whole) if whole and len(whole) == 1 else _needed(list(arg[2]))
        best = _better(best, inner)
        if exact is not None:
            runs = exact
    return _better(best, runs if "" not in runs else None)


def _exact(op, arg) -> frozenset[str] | None:
    """All strings, folded, that an element matches, if they are few."""
    c = sre_constants
    if op is c.LITERAL:
        return frozenset([folded(chr(arg))])
    if op in (c.AT, c.ASSERT, c.ASSERT_NOT):
        return frozenset([""])
    if op is c.IN and all(o is c.LITERAL for o, _ in arg):
        return frozenset(folded(chr(x)) for _, x in arg)
    if op is c.SUBPATTERN:
        return _all_of(arg[3])
    if op is c.BRANCH:
        each = [_all_of(x) for x in arg[1]]
        return frozenset().union(*each) if all(x is not None for x in each) and sum(map(len, each)) <= _MOST else None
    if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[:2] == (0, 1):
        inner = _all_of(arg[2])
        return inner | {""} if inner is not None else None
    return None


def _all_of(items) -> frozenset[str] | None:
    out = frozenset([""])
    for op, arg in items:
        part = _exact(op, arg)
        if part is None or len(out) * len(part) > _MOST:
            return None
        out = frozenset(x + y for x in out for y in part)
    return out


#: the patterns of each group; one is run where the text holds a string of its own
GROUPS = {
    "error": ERRORS, "script": SCRIPTS, "filler": FILLER[:-3], "heading": [HEADINGS], "field": FIELDS, **{f"slot{i}": [p] for i, p in enumerate(SLOTS)},
}


Part = tuple[str, int]


def _automaton() -> tuple[ahocorasick.Automaton, frozenset[Part]]:
    """Finds the patterns, by group and place, whose strings a folded text holds; and those that need none, which always run."""
    by: dict[str, set[Part]] = {}
    always = set()
    for group, patterns in GROUPS.items():
        for i, pattern in enumerate(patterns):
            words = required(pattern)
            if words is None:
                always.add((group, i))
            for word in words or ():
                by.setdefault(word, set()).add((group, i))
    machine = ahocorasick.Automaton()
    for word, parts in by.items():
        machine.add_word(word, frozenset(parts))
    machine.make_automaton()
    return machine, frozenset(always)


_ALL = frozenset((group, i) for group, patterns in GROUPS.items() for i in range(len(patterns)))


@lru_cache(4096)
def _joined(group: str, places: tuple[int, ...]) -> re.Pattern:
    """One expression of some patterns of a group; what others match is not looked for."""
    return re.compile("|".join(GROUPS[group][i] for i in places).replace("(?m)", ""), re.I | re.M)


_LONG_WORDS = bytes(0 if n < 4 else 1 for n in range(256))
_RUN = b"\1" * 9
_WIDE_RUN = re.compile("[一-鿿]{8}")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _kind(text: str, anchors: tuple[ahocorasick.Automaton, frozenset[Part]] | None) -> Iterator[tuple[str, int, int]]:
    """(kind, from, to) of the evidence in a text; without ``anchors`` all patterns are run."""
    parts = _ALL if anchors is None else anchors[1].union(*{found for _, found in anchors[0].iter(folded(text))})
    may: dict[str, list[int]] = {}
    for group, i in sorted(parts):
        may.setdefault(group, []).append(i)
    for kind in ("error", "script"):
        if kind in may:
            yield from ((kind, *m.span()) for m in _joined(kind, tuple(may[kind])).finditer(text))
    slots = [slot for i, slot in enumerate(_SLOT) if f"slot{i}" in may]
    if slots or "field" in may:
        plain = _CODE.sub(lambda m: " " * len(m.group()), text) if "`" in text else text
        if "field" in may:
            yield from (("field", *m.span()) for m in _joined("field", tuple(may["field"])).finditer(plain))
        for slot in slots:
            yield from (("field", *m.span()) for m in slot.finditer(plain))
    for i in may.get("filler", ()):
        yield from (("filler", *m.span()) for m in _FILLER[i].finditer(text))
    if "heading" in may:
        heads = list(_HEADING.finditer(text))
        if len(heads) >= 2:
            yield from (("filler", *m.span()) for m in heads)
    # filler that has no fixed words: one word again and again, or sentences without any short word
    words = text.split()
    repeats = sum(map(eq, words, words[1:])) >= 5
    try:
        lengths = bytes(map(len, words))
    except ValueError:  # a word of more than 255 characters
        lengths = bytes(min(n, 255) for n in map(len, words))
    even = _RUN in lengths.translate(_LONG_WORDS)
    wide = not text.isascii() and not _latin(text) and _WIDE_RUN.search(text) is not None
    for pattern, wanted in zip(_FILLER[-3:], (repeats, wide, even), strict=True):
        m = pattern.search(text) if wanted else None
        if m:
            yield "filler", *m.span()


_FOUND = "doc_id long, source string, lines array<bigint>, words array<int>, passage array<boolean>, evidence array<struct<at:int,kind:string,line:string,evidence:string>>"
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("source", pa.string()), ("lines", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("passage", pa.list_(pa.bool_())),
        ("evidence", pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string()), ("line", pa.string()), ("evidence", pa.string())]))),
    ]
)
_LINES = re.compile("[\\r\\n\\v\\f\\x85\\u2028\\u2029]+")
_NUMBER = re.compile(r"\d+")
_STOPS = (".", "!", "?", "…", "。", "！", "？", '."', ".”", ".)")


def normalised(line: str) -> str:
    """A line in lower case, blanks joined, numbers as 0."""
    return _NUMBER.sub("0", " ".join(line.lower().split()))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of every text as hashes; where there is evidence, what the lines are, and the evidence by the place of its line."""
    anchors, hashed = _automaton(), xxhash.xxh64_intdigest
    for batch in batches:
        lines, words, passages, evidence = [], [], [], []
        for text in batch.column(2).to_pylist():
            text = _LINES.sub("\n", text)
            found = list(_kind(text, anchors))
            own = text.split("\n")
            same = _NUMBER.sub("0", text.lower()).split("\n")
            split = [line.split() for line in (same if len(same) == len(own) else map(normalised, own))]
            lines.append([hashed(" ".join(x).encode("utf-8", "surrogatepass")) - (1 << 63) for x in split])
            words.append([len(x) for x in split] if found else [])
            passages.append([len(x) >= CONTENT_WORDS and y.rstrip().endswith(_STOPS) for x, y in zip(split, own, strict=True)] if found else [])
            places = [text.count("\n", 0, b - len(text[a:b].lstrip())) for _, a, b in found]
            evidence.append([{"at": at, "kind": kind, "line": normalised(own[at]), "evidence": text[a:b]} for at, (kind, a, b) in zip(places, found, strict=True)])
        columns = [batch.column(0), batch.column(1), lines, words, passages, evidence]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def evidence(documents: DataFrame) -> DataFrame:
    """Residual evidence of each document: (doc_id, source, kind, line, evidence).

    ``kind`` is ``error``, ``script``, ``filler`` or ``field``; ``line`` is normalised (lower
    case, blanks joined, numbers as 0). Lines that recur on a host are subtracted, evidence in
    them too, unless too few words are left that could be content and the line mostly stands
    without any. Null and blank texts, and rows without an id, hold no evidence; a null source is a
    host of its own; rows of one id are judged each, and rows delivered twice count twice.
    """
    texts = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    found = cut(texts.mapInArrow(_scan, _FOUND))
    hosts = found.groupBy("source").agg(F.count("*").alias("documents"))
    counted = found.select("source", F.explode(F.array_distinct("lines")).alias("hash")).groupBy("source", "hash").agg((F.count("*") - 1).alias("others")).where("others > 0")
    recurs = share_bound(F.col("l.others"), F.col("h.documents") - 1, -1) >= RECURS_SHARE
    recurrent = counted.alias("l").join(hosts.alias("h"), F.expr("l.source <=> h.source")).where(recurs).select(F.col("l.source").alias("host"), F.col("l.hash").alias("furniture"))

    held = found.where("size(evidence) > 0").withColumn("row", F.monotonically_increasing_id())
    marked = F.expr("transform(evidence, e -> e.at)")
    held = held.select("row", "doc_id", "source", "evidence", marked.alias("marked"), F.posexplode(F.arrays_zip("lines", "words", "passage")).alias("at", "x"))
    held = held.join(recurrent, F.expr("source <=> host") & (F.col("x.lines") == F.col("furniture")), "left")
    own = F.col("furniture").isNull()
    content = F.sum(F.when((own | F.col("x.passage")) & ~F.array_contains("marked", F.col("at")), F.col("x.words")).otherwise(0))
    judged = held.groupBy("row", "doc_id", "source").agg(
        content.alias("content"), F.first("evidence").alias("evidence"), F.map_from_entries(F.collect_list(F.when(F.array_contains("marked", F.col("at")), F.struct("at", F.struct(F.col("x.lines").alias("hash"), (~own).alias("furniture")))))).alias("on"),
    )
    each = judged.select("doc_id", "source", (F.col("content") >= CONTENT_WORDS).alias("beside"), "on", F.explode("evidence").alias("e"))
    each = each.select("doc_id", "source", "beside", "e.kind", "e.line", "e.evidence", F.element_at("on", F.col("e.at")).alias("on")).select("*", "on.hash", "on.furniture")
    # whether a recurrent line with evidence stands beside content as a rule; other lines are not shuffled for it
    rule = each.where("furniture").groupBy(F.col("source").alias("host"), F.col("hash").alias("of")).agg(F.avg(F.col("beside").cast("double")).alias("share"))
    told = each.join(rule, F.expr("furniture AND source <=> host AND hash = of"), "left")
    return told.where(F.expr(f"NOT furniture OR NOT (beside OR share >= {BESIDE_CONTENT})")).select("doc_id", "source", "kind", "line", "evidence")


def residue_documents(documents: DataFrame) -> DataFrame:
    """doc_id and the kinds of evidence of every document to exclude; each id once."""
    return evidence(documents).groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def clean_documents(documents: DataFrame) -> DataFrame:
    """The documents without residue, all their columns as they were; blank texts stay."""
    return documents.join(residue_documents(documents).select("doc_id"), "doc_id", "left_anti")
