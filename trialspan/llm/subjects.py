"""Participant identities: spellings of one id, linked ids, and splits that keep them together.

Method: frontier breadth-first components. Adjacency lists are hash-partitioned by their node,
many seeds are expanded at once, seed labels that meet form a much smaller graph which is solved
in the same way, and components are put into splits in the order of their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialspan.runtime import cut

# Full-width forms, dashes and blanks that stand for plain characters in ids.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
PLAIN_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
DASHES = "‐‑‒–—−"
BLANKS = "   　\t"

_SEP = r"[\s_\-./:|@]+"
_KEY = rf"(?:igt{_SEP})?([a-z]+)(\d{{4}}|\d{{2}})(?!\d)([a-z]*)"
_NUMBER = r"(?:(?:subject|subj|sub|vp|s|p)?[-_#. ]?#?)0*(\d+)"
_VISIT = (
    r"(?:\s*\(\d+\)|[\s_\-./:]*(?:retest|repeat)(?:[\s_\-./:]*r?\d+)?"
    r"|[\s_\-./:]*(?:t|r|ses|session|visit|run|wave)[\s_\-.]*\d+)*"
)
#: study key, arm, number and marks of a visit; arms are words between the key and the number
FORWARD = rf"^{_KEY}(?:{_SEP}([a-z]+\d*))??{_SEP}{_NUMBER}{_VISIT}$"
#: the number first, behind it the study: "0012 - study2019", "s12|study2019", "s12@study2019"
BACKWARD = rf"^{_NUMBER}{_VISIT}\s*[-|@]\s*{_KEY}(?:{_SEP}([a-z]+))?{_VISIT}$"


def plain_id(raw: Column) -> Column:
    """The id with full-width characters, dashes, blanks and letter case made uniform."""
    text = F.translate(raw, FULL_WIDTH + DASHES + BLANKS, PLAIN_WIDTH + "-" * len(DASHES) + " " * len(BLANKS))
    return F.lower(F.trim(text))


def participant_key(raw: Column) -> Column:
    """``study key[_arm]#number`` of an id as written, or ``?`` and the plain id where it has no such shape.

    Null and blank ids give null. Two-digit years are years after 2000; leading zeros, markers
    such as ``s``, ``vp`` or ``sub-`` and marks of a session, visit or re-test are left out.
    """
    text = plain_id(raw)
    ahead, behind = F.regexp_extract(text, FORWARD, 5), F.regexp_extract(text, BACKWARD, 1)

    def joined(pattern: str, first: int, number: int) -> Column:
        part = [F.regexp_extract(text, pattern, first + i) for i in range(4)]
        year = F.when(F.length(part[1]) == 2, F.concat(F.lit("20"), part[1])).otherwise(part[1])
        arm = F.when(part[3] == "", F.lit("")).otherwise(F.concat(F.lit("_"), part[3]))
        return F.concat(part[0], year, part[2], arm, F.lit("#"), F.regexp_extract(text, pattern, number))

    return (
        F.when(raw.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(ahead != "", joined(FORWARD, 1, 5))
        .when(behind != "", joined(BACKWARD, 2, 1))
        .otherwise(F.concat(F.lit("?"), text))
    )


def confirmed_links(links: DataFrame) -> DataFrame:
    """Edges (a, b) between participants from notes whose status is ``confirmed`` in any case.

    Notes with a null id, and notes that link a participant to itself, give no edge.
    """
    held = links.where(F.lower(F.trim("status")) == "confirmed")
    return (
        held.select(participant_key(F.col("sid_a")).alias("a"), participant_key(F.col("sid_b")).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .distinct()
    )


def frontier_components(edges: DataFrame, level: int = 0) -> DataFrame:
    """Components (node, label) of an undirected graph given as edges (a, b); empty in, empty out.

    Seeds are the nodes whose hash is the least among their neighbours, so every component has
    one. All seeds expand together; each round joins the newest frontier only with the adjacency
    lists. Where areas of two seeds touch, their labels become an edge of the next graph, which
    has at most half the nodes and is solved in the same way. Every round is checkpointed.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    adjacent = cut(both.repartition(F.col("a")))
    if adjacent.isEmpty():
        return adjacent.select(F.col("a").alias("node"), F.col("b").alias("label"))

    def rank(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(level), F.col(c)), F.col(c))

    around = adjacent.groupBy("a").agg(F.min(rank("b")).alias("least"))
    frontier = cut(around.where(rank("a") < F.col("least")).select(F.col("a").alias("node"), F.col("a").alias("label")))
    areas = frontier
    while True:
        reached = frontier.join(adjacent, frontier.node == adjacent.a).select(F.col("b").alias("node"), "label")
        fresh = reached.join(areas.select("node"), "node", "left_anti").groupBy("node").agg(F.min("label").alias("label"))
        frontier = cut(fresh)
        if frontier.isEmpty():
            break
        areas = areas.union(frontier)
    left, right = areas.toDF("a", "x"), areas.toDF("b", "y")
    touching = adjacent.where("a < b").join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    touching = cut(touching)
    if touching.isEmpty():
        return areas
    merged = frontier_components(touching, level + 1).toDF("label", "root")
    return areas.join(merged, "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def participants(manifest: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct stored ids with their participant: (subject_id, participant); null ids have no row."""
    ids = manifest.select("subject_id").where("subject_id IS NOT NULL").distinct()
    keyed = ids.select("subject_id", F.coalesce(participant_key(F.col("subject_id")), F.lit("?")).alias("node"))
    parts = frontier_components(confirmed_links(links))
    return keyed.join(parts, "node", "left").select("subject_id", F.coalesce("label", "node").alias("participant"))


def same_participant_pairs(manifest: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of different stored ids of one participant, the smaller string first.

    Blank ids name nobody and are in no pair. Rows are made distinct before the join, so hot
    participants cost no more than their spellings.
    """
    known = cut(participants(manifest, links).where("participant <> '?'"))
    left = known.select(F.col("subject_id").alias("subject_id_a"), "participant")
    right = known.select(F.col("subject_id").alias("subject_id_b"), "participant")
    return left.join(right, "participant").where("subject_id_a < subject_id_b").select("subject_id_a", "subject_id_b")


def assign_splits(manifest: DataFrame, links: DataFrame, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), buckets: int = 4096) -> DataFrame:
    """Every manifest row with its participant and split: (row_id, participant, assigned_split).

    All rows of a participant get one split. Components are laid out in hash order, those that
    hold over a tenth of the smallest split first, and the line of rows is cut at the shares; a
    component belongs where its first row lies. A row without a usable id joins the participant
    of its ``prompt_id`` when another delivery names one, else all rows of its ``prompt_id``
    form their own unit; without a prompt too, the row stands alone. The running totals go over
    ``buckets`` hash buckets, so no task holds all components.
    """
    names = participants(manifest, links).where("participant <> '?'")
    rows = manifest.select("row_id", "prompt_id", "subject_id").join(names, "subject_id", "left")
    lacking = rows.where("participant IS NULL AND prompt_id IS NOT NULL").select("prompt_id").distinct()
    of_prompt = rows.where("participant IS NOT NULL").join(lacking, "prompt_id", "left_semi").groupBy("prompt_id").agg(F.min("participant").alias("by_prompt"))
    alone = F.when(F.col("prompt_id").isNotNull(), F.concat(F.lit("prompt:"), "prompt_id")).otherwise(F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    rows = cut(rows.join(of_prompt, "prompt_id", "left").select("row_id", F.coalesce("participant", "by_prompt", alone).alias("participant")))
    sizes = rows.groupBy("participant").agg(F.count("*").alias("n"))
    total = rows.groupBy().agg(F.count("*").alias("total"))
    placed = sizes.join(F.broadcast(total)).withColumn("h", F.xxhash64("participant"))
    big = F.col("n") > F.col("total") * (min(s for s in shares if s > 0) / 10)
    placed = placed.withColumn("bucket", F.when(big, F.lit(-1)).otherwise(F.pmod("h", F.lit(buckets)).cast("int")))
    fill = placed.groupBy("bucket").agg(F.sum("n").alias("filled"))
    before = fill.withColumn("start", F.sum("filled").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("bucket", F.coalesce("start", F.lit(0)).alias("start"))
    inside = F.sum("n").over(W.partitionBy("bucket").orderBy("h", "participant").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    at = placed.withColumn("inside", inside).join(F.broadcast(before), "bucket").withColumn("at", (F.col("start") + F.col("inside")) / F.col("total"))
    split = F.when(F.col("at") < shares[0], "train").when(F.col("at") < shares[0] + shares[1], "validation").otherwise("test")
    return rows.join(at.select("participant", split.alias("assigned_split")), "participant").select("row_id", "participant", "assigned_split")


def split_report(assigned: DataFrame) -> DataFrame:
    """Rows, participants and share of all rows per split; the empty table gives no row."""
    by = assigned.groupBy("assigned_split").agg(F.count("*").alias("n_rows"), F.countDistinct("participant").alias("n_participants"))
    return by.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(W.partitionBy()))
