"""Token counts, truncation, pieces, packing, leaks and residue on small inputs."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trialspan.llm import leaks, packing, pieces, residue, tokens, truncation
from trialspan.llm.words import words_of

ODD = [None, "", " ", "\n\n", "x" * 200_000, "字" * 3000, "a\x1cb\u0085c  d", "'s don't ½ ² 12", "\U0001f0cf x", "-" * 700]


@pytest.fixture(scope="module")
def counter():
    return tokens.PieceCounts(tokens.VOCABULARY)


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokens.read_ranks(tokens.VOCABULARY), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_token_counts_are_exact(counter, encoding, text):
    text = text.encode("utf-8", "ignore").decode()
    assert counter.counts([text]) == [len(encoding.encode_ordinary(text))]


def test_token_counts_of_odd_texts(counter, encoding):
    assert counter.counts(ODD) == [len(encoding.encode_ordinary(t)) if t else 0 for t in ODD]


def test_token_queries(spark, tables):
    from trialspan.llm import queries as Q

    one = Q.p1_records(spark, tables).toPandas()
    corpus = spark.read.parquet(f"{tables}/corpus.parquet").toPandas()
    assert (one.origin == "corpus").sum() == corpus.prompt_id.nunique() + corpus.prompt_id.isna().sum()
    total = Q.p1_budget(spark, tables).agg(F.sum("n_tokens")).first()[0]
    assert total == one.n_tokens_exact.sum()


def test_token_tables_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "two words", 6)], "`text id` int, text string, n_tokens_exact int")
    assert sorted(tuple(r) for r in tokens.with_tokens(df).collect()) == [(1, 0), (2, 2)]
    assert tokens.with_tokens(df.limit(0)).count() == 0
    assert [r.l for r in spark.createDataFrame([("EN",), ("en-EN",), ("und",), (None,), ("",)], "l string").select(tokens.language(F.col("l")).alias("l")).collect()] == ["en", "en", None, None, None]


CORPUS = "row_id long, source string, n_answer_spans int, text string, gram string, tail string"
LINE = "You take <<{}>>: plus {}.0, minus 0.0."


def session(n=40, seed=1):
    rng = random.Random(seed)
    return "\n".join(LINE.format(rng.choice("ABCD"), rng.randint(50, 120)) for _ in range(n))


def test_truncation(spark):
    whole = [session(seed=s) for s in range(60)]
    ends = ["", "\nSigned: Halner lab", "\n| 3 | 4 |", "\nTotal: 5 points", "\nSigned: Osnmak lab", "\nTotal: 9 points"]
    rows = [(i, "a" if i % 2 else "A ", 40, t + ends[i % len(ends)]) for i, t in enumerate(whole)]
    base = whole[0]
    cut = [base[:-1], base[:-3], base[:-12], base[:-22], base[:-30], base + "\nYou", base[:-9] + "…", base + " [...]", base[:-12] + "... [+90 chars]", base + "\nYou take <", base[:-10] + "�"]
    rows += [(1000 + i, "b", None, t) for i, t in enumerate(cut)] + [(2000, None, 41, base), (2001, None, 39, base), (2002, None, None, None), (2003, None, None, ""), (2004, None, 1, None), (2005, None, None, "x" * 100_000 + ".")]
    df = spark.createDataFrame([(*r, "g", "t") for r in rows], CORPUS)
    got = {r.row_id for r in truncation.judged(df).where("cut").collect()}
    assert got == {1000 + i for i in range(len(cut))} | {2000, 2004}
    assert truncation.judged(df).count() == len(rows) and truncation.judged(df.limit(0)).count() == 0
    assert {r.source: r.n_cut for r in truncation.truncation_report(df).collect()} == {"a": 0, "b": len(cut), None: 2}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["<<A>>", "word", ". ", "\n", " ", "<<two words>>", "<", ">", "中。", "x" * 40]), min_size=40, max_size=160))
def test_pieces_restore_the_text(spark, parts):
    text = "".join(parts)
    rows = pieces.cut_texts(spark.createDataFrame([(1, text)], "row_id int, text string"), limit=100, overlap=20).orderBy("piece").collect()
    assert bool(rows) == (len(text) > 100)
    if rows:
        assert "".join(r.piece_text[len(r.piece_text) - r.n_new :] for r in rows) == text
        for r in rows:
            assert len(r.piece_text) <= 100 and text[r.start : r.start + len(r.piece_text)] == r.piece_text and len(r.piece_text) - r.n_new <= 20
            end = r.start + len(r.piece_text)
            for m in pieces_markers(text):
                assert not m[0] < end < m[1]


def pieces_markers(text):
    import re

    return [m.span() for m in re.finditer(r"<<[^<>]{0,76}>>", text)]


def test_a_broken_word_does_not_become_regular_by_repetition(spark):
    for times in (1, 10):
        body = [f"Subject {i} read the sheet and then did the task slowly until it was done." for i in range(40 * times)]
        broken = [f"Subject {i} came back. Number {i} again did the tas" for i in range(6 * times)]
        closed = [f"Subject {i} came back and left.\nEnd of record {i}" for i in range(6 * times)]
        rows = [(i, t) for i, t in enumerate(body + broken + closed)]
        df = spark.createDataFrame([(i, "s", t, None) for i, t in rows], "row_id long, source string, text string, n_answer_spans int")
        got = {r.row_id for r in truncation.judged(df).where("cut").collect()}
        assert got == set(range(len(body), len(body) + len(broken)))


def test_a_piece_behind_a_long_marker_does_not_begin_within_it(spark):
    text = "a b " * 1390 + "<<" + "w " * 115 + ">>" + "c d " * 400
    rows = pieces.cut_texts(spark.createDataFrame([(1, text)], "row_id int, text string")).orderBy("piece").collect()
    inside = range(text.index("<<") + 1, text.index(">>") + 2)
    assert len(rows) > 1 and not any(r.start in inside or r.start + len(r.piece_text) in inside for r in rows)
    assert "".join(r.piece_text[len(r.piece_text) - r.n_new :] for r in rows) == text


def test_pieces_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x" * 6000, 0), (3, "y" * 6001, 0), (4, "z " * 40_000, 0), (5, "\U0001f0cf" * 6001, 0), (None, "n" * 7000, 0)], "row_id int, text string, piece int")
    assert sorted((r.row_id or 0) for r in pieces.oversized(df).collect()) == [0, 3, 4, 5]
    assert pieces.cut_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.cut_texts(df, limit=100, overlap=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_places_every_item(sizes):
    histogram = np.bincount(sizes or [0], minlength=65)
    histogram[0] = 0
    left = histogram.copy()
    for combo, n in packing.plan(histogram, window=2):
        assert sum(combo) <= 64 and n > 0
        for x in combo:
            left[x] -= n
    assert not left.any()


def test_packing(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 900) for _ in range(1500)] + [300] * 800 + [5000, 2048, 4096, 0, None, -3]
    df = spark.createDataFrame([(i, s, 1, 2) for i, s in enumerate(sizes)], "doc_id long, size int, bucket int, place int")
    got = packing.pack(df, "doc_id", "size").toPandas()
    placed = got[got.container.notna()].sort_values(["container", "place"])
    assert len(got) - len(placed) == 3 and placed.n_tokens.sum() == sum(s for s in sizes if s and s > 0)
    by = placed.groupby("container")
    assert by.n_tokens.sum().max() <= 2048 and (by.n_tokens.cumsum() - placed.n_tokens == placed.offset).all() and not placed.duplicated(["container", "place"]).any()
    assert by.ngroups <= -(-placed.n_tokens.sum() // 2048) * 1.01 + 1
    assert sorted(got[got.doc_id == 2300].n_tokens) == [904, 2048, 2048]
    assert packing.pack(df.limit(0), "doc_id", "size").count() == 0
    assert packing.fill_report(packing.pack(df.limit(0), "doc_id", "size")).first().n_containers == 0


WORDS = [f"w{i}" for i in range(400)]


def test_leaks(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(60)), "s") for k in range(1, 9)]
    text = {k: t.split() for k, t, _ in items}
    fill = lambda n: [rng.choice(WORDS) for _ in range(n)]
    swapped = [w if i % 6 else "other" for i, w in enumerate(text[2])]
    shuffled = rng.sample(text[3], 60)
    docs = [
        (1, fill(200) + text[1] + fill(100)), (2, fill(30) + swapped + fill(30)), (3, shuffled), (4, fill(50) + text[4][:20] + fill(300) + text[4][20:40]), (5, text[5][10:50] + fill(500)),
        (6, fill(100) + text[6][:15] + fill(90)), (7, [w.upper() + "," for w in text[7]]), (7, text[7]), (8, ["<b>" + w[:1] + "­" + w[1:] + "</b>&nbsp;" for w in text[8]]), (9, text[1]),
    ]
    df = spark.createDataFrame([(i, " ".join(w), "k") for i, w in docs] + [(20, None, None), (21, "", None), (None, " ".join(text[1]), None), (22, "w1 " * 100_000, None)], "doc_id long, text string, item_id string")
    query = spark.createDataFrame([*items, (30, None, "s"), (31, "", "s"), (32, "two words", "s"), (1, items[0][1], "s")], "item_id long, text string, item_set string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, query).collect()}
    assert got == {(1, 1), (2, 2), (5, 5), (7, 7), (8, 8), (9, 1)}
    assert leaks.leaked_items(df.limit(0), query).count() == 0 and leaks.leaked_items(df, query.limit(0)).count() == 0
    leaks.BLOCK, kept = 3, leaks.BLOCK
    try:
        assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, query).collect()} == got
    finally:
        leaks.BLOCK = kept


def test_tiles_and_subsequence():
    assert leaks.tiles([1, 2, 3, 4, 5, 6], [4, 5, 6, 9, 1, 2, 3]) == [(3, 0, 3), (0, 4, 3)]
    assert leaks.ordered_cover([(3, 0, 3), (0, 4, 3)]) == 3 and leaks.ordered_cover([]) == 0
    item, other = [1, 2, 3, 2, 5], [2, 1, 3, 5, 9]
    at = leaks.places_of(item)
    assert leaks.common_in_order(5, [at.get(x, 0) for x in other]) == 3


def test_words():
    assert words_of("Ver​gés <b>х</b>&nbsp;ＡＢ「中文」") == ["verges", "x", "ab", "中", "文"]


HOST = "study_site_web"


def test_leaks_with_exchanged_and_missing_words_spread_over_the_passage(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(60)]
    filler = lambda n: [word() for _ in range(n)]

    def pattern(p, missing=False):
        out = []
        for i, w in enumerate(item):
            if p[i % len(p)] == "x":
                out.append(w)
            elif not missing:
                out.append(word())
        return filler(150) + out + filler(300)

    docs = [("xx_", True), ("xx_x_", True), ("xxx_x_", True), ("xxx_", True), ("x_x_x", True), ("x_", False), ("xx_x__", False), ("x__", False)]
    rows = [(i, " ".join(pattern(p))) for i, (p, _) in enumerate(docs)] + [(50 + i, " ".join(pattern(p, True))) for i, (p, ok) in enumerate(docs) if ok]
    mixed = list(item)
    rng.shuffle(mixed)
    rows += [(90, " ".join(filler(30) + mixed)), (91, " ".join(filler(700) + item)), (92, " ".join(item[:35])), (93, " ".join(x for w in item for x in (w, word())))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in leaks.leaked_items(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {i for i, (_, ok) in enumerate(docs) if ok} | {50 + i for i, (_, ok) in enumerate(docs) if ok} | {91}


def test_residue(spark):
    real = "Right after the first trials, two raters compared the costly deck. The adapter kept the blue log file for 12 minutes. Most sessions were kept until the lamp kept flickering, and nobody checked the keys again that day."
    bad = [
        "Thank you, {{ name }}, for taking part.", real + "\n\nDear null, your balance was %(total)s points.", "Gracias, «fecha_sesion», por participar.", "Heading\nYour text\nCaption goes here", "lorem ipsum dolor sit amet",
        "Error 404\nThe page could not be found", "El archivo ya no existe", "Die Seite wurde nicht gefunden.", "服务器没有响应，请稍后再试", "Fatal: abc_query line 12: no rows returned", "<noscript>Please enable JavaScript in your browser", "JavaScript is required. the experiment cannot be displayed",
        "text " * 20, "Sontur quidam dolvit temporu temporu. Velora ampire marisque sigra nolunt centu.", "This report covers undefined trials run on #REF!.",
    ]
    good = [
        real, "When the server answered with error 500, the timer stopped.", "The task was written in JavaScript and needs a browser with scripts enabled.", "The field `{{name}}` is replaced before it is sent.", "Missing times are coded as NaN in the table.",
        "The set of labels is {A, B, C, D}, and the weight is $w_{t}$.", 'Each trial is {"deck": "A", "gain": 5}.', "We had access denied at the clinic for a week.", "The header uses [deck] for the pile and <<key>> for the answer.", "You take <<A>>: plus 5.0, minus 0.0.", "  ", "Two participants saw “404 page not found” on their first try.",
    ]
    rows = [(i, HOST, t) for i, t in enumerate(bad)] + [(100 + i, None, t) for i, t in enumerate(good)] + [(200, HOST, None), (201, HOST, ""), (None, HOST, bad[0]), (202, None, "x" * 300_000)]
    df = spark.createDataFrame([(*r, "k", "l") for r in rows], "doc_id long, source string, text string, kind string, line string")
    assert {r.doc_id for r in residue.residue_documents(df).collect()} == set(range(len(bad)))
    assert residue.clean_documents(df).count() == len(rows) - len(bad) and residue.clean_documents(df).columns == df.columns
    assert residue.evidence(df.limit(0)).count() == 0 and residue.clean_documents(df.limit(0)).count() == 0


def test_boilerplate_of_a_host_is_no_residue(spark):
    body = " ".join(f"word{i} and" for i in range(60))
    notice = "Please enable JavaScript to use the menu."
    rows = [(i, "a", f"{body} number {i}.\n{notice}") for i in range(40)] + [(100, "b", notice), (101, "a", "Error 404\nThe page could not be found")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in residue.residue_documents(df).collect()} == {100, 101}


def test_an_error_template_with_furniture_is_residue_on_a_host_of_any_size(spark):
    """The furniture of 45 words is no content: on one host it stands around an error line, on another around real texts."""
    menu = " ".join(f"menu{i}" for i in range(45))
    notice = "Please enable JavaScript to use the menu."
    for times in (1, 6):
        pages = [(i, "errors", f"{menu}\nError 404\nThe page could not be found\n{menu} footer") for i in range(30 * times)]
        texts = [(1000 + i, "texts", f"{menu}\n{' '.join(f'{chr(97 + i % 26)}{chr(97 + i // 26)}word{j}' for j in range(50))}\n{notice}") for i in range(30 * times)]
        short = [(2000, "texts", f"{menu}\nSee you soon.\n{notice}"), (2001, "texts", f"{menu}\n{notice}\nNot found: the results table is not available."), (2002, None, f"{menu}\n{notice}")]
        df = spark.createDataFrame(pages + texts + short, "doc_id long, source string, text string")
        assert {r.doc_id for r in residue.residue_documents(df).collect()} == {i for i, _, _ in pages} | {2001, 2002}


def test_unfilled_values_are_told_by_their_place(spark):
    bad = ["It took null minutes.", "You won XXXX points today.", "Hallo undefined,\nhier", "Dear {name}, hello", "We met at None.", "第一轮在undefined进行", "感谢{0}参加", "It lasted n_minutes minutes."]
    good = ["An undefined outcome was dropped.", "Of <b>55</b> minutes.", "The value is null.", "记为NaN的时间", "Dear Ann, hello", "None of the minutes", "A set {0} of points"]
    df = spark.createDataFrame([(i, "h", t) for i, t in enumerate(bad)] + [(100 + i, "h", t) for i, t in enumerate(good)], "doc_id long, source string, text string")
    assert {r.doc_id for r in residue.residue_documents(df).collect()} == set(range(len(bad)))


def made_match(items, rng):
    """A random text that a parsed expression matches, but for what it asks of its neighbourhood."""
    out = []
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out.append(rng.choice([chr(arg).lower(), chr(arg).upper()]))
        elif name == "NOT_LITERAL":
            out.append("q" if chr(arg) != "q" else "w")
        elif name == "ANY":
            out.append("q")
        elif name == "IN":
            sure = [chr(x) for o, x in arg if str(o) == "LITERAL"] + [chr(x[0]) for o, x in arg if str(o) == "RANGE"]
            kind = {"CATEGORY_SPACE": " ", "CATEGORY_WORD": "q", "CATEGORY_DIGIT": "7", "CATEGORY_NOT_WORD": "-"}
            out.append("q" if str(arg[0][0]) == "NEGATE" else rng.choice(sure + [kind[str(x)] for o, x in arg if str(o) == "CATEGORY"]))
        elif name == "BRANCH":
            out.append(made_match(rng.choice(arg[1]), rng))
        elif name == "SUBPATTERN":
            out.append(made_match(arg[3], rng))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += [made_match(arg[2], rng) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 3)))]
    return "".join(out)


def test_the_residue_filter_drops_no_match():
    rng, anchors = random.Random(5), residue._automaton()
    texts = [
        "Hola null,", "Hola [nombre],", "Hi undefined,", "Hi [Name],", "Caro null,", "Cara [nome],", "took null minutes", "duró undefined minutos", "dauerte null Minuten", "Guthaben war null Punkte", "进行，共null分钟", "Error: 404", "Error code 503",
        "HTTP: 503", "Fehler: 500", "Our server is currently down", "Scripts appear to be blocked", "activar scripts", "Bitte Scripts aktivieren", "Escriba su texto", "Title\nTitle", "ERROR İNESPERADO", "ſcriptſ are required",
    ]
    assert all(list(residue._kind(t, anchors)) for t in texts)
    for pattern in (p for patterns in residue.GROUPS.values() for p in patterns):
        tree = residue.sre_parser.parse(pattern, residue.re.I | residue.re.M)
        texts += [made_match(tree, rng) for _ in range(60)]
    found = [list(residue._kind(t, None)) for t in texts]
    assert [list(residue._kind(t, anchors)) for t in texts] == found and sum(map(bool, found)) > len(texts) // 2


def test_words_in_order_of_many_candidates_equal_the_plain_count():
    """Items of over 64 and 128 words carry from one word of bits to the next; documents go together, with the same pairs as one by one."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate((2, 10, 63, 64, 65, 127, 128, 129, 200, 64))]
    items = leaks._Items(rows)
    (block,) = items.blocks
    lanes = [(x, block.row_of[rng.choice(block.items[x], rng.integers(1, 300))]) for x in range(len(rows)) for _ in range(20)]
    want = []
    for x, words in lanes:
        where = leaks.places_of(block.items[x].tolist())
        want.append(leaks.common_in_order(len(block.items[x]), [where[w] for w in block.own[words].tolist()]))
    assert block._common(lanes).tolist() == want
    documents = [["other"], [], *[rows[i % 10][1].split()[:-1] + ["x", "y"] for i in range(12)]]
    together = sorted(items.leaked(documents))
    assert together == sorted((i, *found) for i, d in enumerate(documents) for _, *found in items.leaked([d])) and len(together) >= 10


def test_stretches_begin_where_a_plain_count_lets_them(monkeypatch):
    """Items of one byte of counts and of two; documents go together, over borders of what is held at a time."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(40)]
    often = np.array([12] * 3 + [1] * 37) / 73
    for sizes in ((2, 3, 20, 21, 30, 40, 41, 60, 61, 62, 90), (20, 30, 280, 290, 400)):
        rows = [(i, " ".join(rng.choice(vocabulary, n, p=often))) for i, n in enumerate(sizes)]
        documents = [rng.choice([*vocabulary, *(f"x{i}" for i in range(15))], n) for n in (0, 1, 5, 700, 30, 1, 900)] + [np.array(["w0"] * 500), np.array(rows[-1][1].split() * 2)]
        items = leaks._Items(rows)
        (block,) = items.blocks
        listed = [block.rows(np.array([items.vocabulary.get(w, 0) for w in d], np.int64)) for d in documents]
        length = np.array([len(d) for d in listed])
        want = set()
        for group in block.alike:
            for x in [x for x in range(len(sizes)) if group.first <= x and block.span[x] <= group.span and block.size[x] <= leaks.ALIKE * block.size[group.first]]:
                own = Counter({w: int(n) for w, n in enumerate(block.by_item[x]) if n})
                for d, at in zip(listed, (np.cumsum(length) - length).tolist(), strict=True):
                    for p, w in enumerate(d.tolist()):
                        if own[w] and (Counter(d[p : p + group.span].tolist()) & own).total() >= block.need[x]:
                            want.add((at + p, x))
        for held in (1, 700, leaks.HELD):
            monkeypatch.setattr(leaks, "HELD", held)
            got = list(zip(*(a.tolist() for a in block._begins(np.concatenate(listed), length)), strict=True))
            assert set(got) == want and len(got) == len(want) > 100
        monkeypatch.undo()
        whole = sorted(items.leaked([d.tolist() for d in documents]))
        monkeypatch.setattr(leaks, "LISTED", 10)
        assert sorted(items.leaked([d.tolist() for d in documents])) == whole and whole
        monkeypatch.undo()


def test_a_word_counts_no_more_often_than_the_item_has_it(monkeypatch):
    """Texts full of the words that an item repeats are no candidates: nothing of them is counted in order."""
    item = [w for i in range(12) for w in ("the", "of", f"word{i}", f"other{i}", f"last{i}")]
    counted = []
    common = leaks._Block._common
    monkeypatch.setattr(leaks._Block, "_common", lambda self, lanes: (counted.append(len(lanes)), common(self, lanes))[1])
    items = leaks._Items([(1, " ".join(item))])
    full = [w for i in range(60) for w in (*["the", "of"] * 5, "the", f"{('word', 'other', 'last')[i % 3]}{i // 3 % 12}")]
    assert list(items.leaked([full])) == [] and sum(counted) == 0
    assert [found[:2] for found in items.leaked([["the"] * 50 + item + ["of"] * 50])] == [(0, 1)] and sum(counted) > 0
