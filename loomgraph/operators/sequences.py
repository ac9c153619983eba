"""Token sequences: windows, gap groups, segments, packing. Windows run per document, which bounds each task by its longest document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.operators.ranks import rank_in_order


def offsets(parts: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """parts with start and end: places of each part in the joined text of its document."""
    w = W.partitionBy(doc).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)).cast("long")
    return parts.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


#: Code points of a stretch in the join of first_overlap().
STRETCH = 64


def first_overlap(tokens: DataFrame, spans: DataFrame, doc: str) -> DataFrame:
    """Tokens (doc, pos, start, end) with the span (doc, span_start, span_end, label) that overlaps each; of several the first. Others get a null label.

    Both are laid out over stretches of STRETCH code points, which are the key of the join: a document costs what its tokens and spans are long.
    """
    over = lambda a, z: F.explode(F.sequence(F.expr(f"{a} div {STRETCH}"), F.expr(f"greatest({z} - 1, {a}) div {STRETCH}"))).alias("stretch")
    hit = (F.col("start") < F.col("span_end")) & (F.col("end") > F.col("span_start"))
    laid = tokens.select(doc, "pos", "start", "end", over("start", "end"))
    joined = laid.join(spans.select(doc, "span_start", "span_end", "label", over("span_start", "span_end")), [doc, "stretch"]).where(hit)
    return tokens.join(joined.groupBy(doc, "pos").agg(F.min_by("label", "span_start").alias("label")), [doc, "pos"], "left")


def gap_groups(lines: DataFrame, doc: str, pos: str, labelled: Column, gap: int, blank: Column | None = None) -> DataFrame:
    """The labelled lines with group_no: a new group begins where the last labelled line is more than gap lines back or a blank line lies between."""
    whole = W.partitionBy(doc).orderBy(pos)
    lines = lines.withColumn("__p", F.sum(F.lit(0) if blank is None else blank.cast("int")).over(whole.rowsBetween(W.unboundedPreceding, 0)))
    own = lines.where(labelled)
    fresh = F.coalesce(((F.col(pos) - F.lag(pos).over(whole) > gap) | (F.col("__p") != F.lag("__p").over(whole))).cast("int"), F.lit(1))
    return own.withColumn("group_no", F.sum(fresh).over(whole).cast("long")).drop("__p")


def with_blanks(lines: DataFrame, doc: str, pos: str, blank: Column) -> DataFrame:
    """lines with before and after: the places of the last blank line up to each and of the first from it on, null if there is none."""
    w = W.partitionBy(doc).orderBy(pos)
    at = F.when(blank, F.col(pos))
    return lines.withColumns({"before": F.max(at).over(w.rowsBetween(W.unboundedPreceding, 0)), "after": F.min(at).over(w.rowsBetween(0, W.unboundedFollowing))})


def context(lines: DataFrame, groups: DataFrame, doc: str, pos: str, width: int) -> DataFrame:
    """(doc, group_no, lines' columns): the lines from width before a group's first to width - 1 after its last.

    If groups were made from lines with_blanks, a window begins no earlier than the last blank line before the group, which is part of it, and ends
    before the first one after it; no blank line lies within a group. A group's places are laid out and joined to the lines by place.
    """
    clipped = {"before", "after"} <= set(groups.columns)
    edges = [F.min("before").alias("before"), F.max("after").alias("after")] if clipped else []
    bounds = groups.groupBy(doc, "group_no").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), *edges)
    lo, hi = F.greatest(F.col("first") - width, F.lit(0)), F.col("last") + width
    if clipped:
        lo, hi = F.greatest(lo, F.coalesce("before", F.lit(0))), F.least(hi, F.coalesce("after", hi))
    places = bounds.select(doc, "group_no", F.explode(F.sequence(lo, hi - 1)).alias(pos))
    return lines.join(places, [doc, pos])


def retokenize(words: DataFrame, tokens: DataFrame, doc: str) -> DataFrame:
    """tokens (doc, pos, end, ...) with the label of the word (doc, start, end, label) that covers each token's last character.

    An as-of join by one pass in order: a token takes the label of the first word that ends where it does or later.
    """
    own = tokens.select(doc, F.col("end").alias("__at"), F.lit(0).alias("__kind"), "pos", F.lit(None).cast("long").alias("__begin"), F.lit(None).cast("boolean").alias("label"))
    old = words.select(doc, F.col("end").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("int").alias("pos"), F.col("start").cast("long").alias("__begin"), "label")
    w = W.partitionBy(doc).orderBy("__at", "__kind").rowsBetween(0, W.unboundedFollowing)
    nxt = F.first(F.when(F.col("__kind") == 1, F.struct("__begin", "label")), ignorenulls=True).over(w)
    got = own.unionByName(old).withColumn("__x", nxt).where("__kind = 0")
    return tokens.join(got.select(doc, "pos", F.when(F.col("__x.__begin") < F.col("__at"), F.col("__x.label")).alias("label")), [doc, "pos"])


def chance(*parts: Column | str, seed: int = 0) -> Column:
    """A number from 0 up to 1 that depends on the parts and the seed alone, so that a task run again draws the same."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def dropout(tokens: DataFrame, doc: str, pos: str, token: str, case: float, plural: float, word: float, seed: int = 0) -> DataFrame:
    """tokens with dropped: by chance in lower case if capitalised, without a trailing s, or empty, each with its own probability."""
    draw = lambda k: chance(doc, pos, F.lit(k), seed=seed)
    t = F.when((F.substring(token, 1, 1).rlike(r"^\p{Lu}")) & (draw("case") < case), F.lower(token)).otherwise(F.col(token))
    t = F.when(t.endswith("s") & (draw("plural") < plural), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)
    return tokens.withColumn("dropped", F.when(draw("word") < word, F.lit("")).otherwise(t))


def shuffled(rows: DataFrame, key: str, chunk: int, seed: int = 0) -> DataFrame:
    """rows with chunk_order and place: chunks of `chunk` neighbours (by key, a long) in an order by chance, and each row's place within its chunk by chance.

    Sorting by (chunk_order, place) gives the order; nothing is sorted here beyond one chunk.
    """
    rows = rows.withColumn("__c", F.expr(f"{key} div {chunk}"))
    place = F.row_number().over(W.partitionBy("__c").orderBy(chance(key, seed=seed), key))
    return rows.withColumn("chunk_order", chance("__c", F.lit("chunk"), seed=seed)).withColumn("place", place).drop("__c")


def mix(parts: dict[str, DataFrame], key: str, seed: int = 0) -> DataFrame:
    """The rows of several datasets with source and draw: sorting by draw mixes them by chance, and each dataset keeps all its rows."""
    out = None
    for name, df in parts.items():
        own = df.withColumn("source", F.lit(name)).withColumn("draw", chance(key, F.lit(name), seed=seed))
        out = own if out is None else out.unionByName(own)
    return out


def delta_encode(rows: DataFrame, number: str, span: int = 65_536) -> DataFrame:
    """rows (number distinct) with delta: the distance to the next smaller number, for the smallest its own value.

    Within stretches of `span` numbers by a window, across them by the largest of each.
    """
    rows = rows.withColumn("__s", F.expr(f"{number} div {span}"))
    edge = rows.groupBy("__s").agg(F.max(number).alias("__m"))
    edge = edge.withColumn("__last", F.lag("__m").over(W.orderBy("__s"))).select("__s", "__last")  # one row for each stretch
    prev = F.coalesce(F.lag(number).over(W.partitionBy("__s").orderBy(number)), F.col("__last"), F.lit(0))
    return rows.join(edge, "__s").withColumn("delta", (F.col(number) - prev).cast("long")).drop("__s", "__last")


def delta_decode(rows: DataFrame, place: str, delta: str = "delta", span: int = 65_536) -> DataFrame:
    """rows (place distinct) with number: the sum of the deltas up to each place, added up by stretches of `span` places."""
    rows = rows.withColumn("__s", F.expr(f"{place} div {span}"))
    sums = rows.groupBy("__s").agg(F.sum(delta).alias("__t"))
    sums = sums.withColumn("__before", F.sum("__t").over(W.orderBy("__s")) - F.col("__t")).select("__s", "__before")
    own = F.sum(delta).over(W.partitionBy("__s").orderBy(place))
    return rows.withColumn("__own", own).join(sums, "__s").withColumn("number", (F.col("__own") + F.col("__before")).cast("long")).drop("__s", "__own", "__before")


def sliding(tokens: DataFrame, doc: str, pos: str, token: str, width: int, labelled: Column | None = None) -> DataFrame:
    """(doc, pos, window array) of the 2 * width tokens from width before to width - 1 after each labelled token, or each token.

    Those nearer than width to the beginning, or not more than width from the end, have no window.
    """
    w = W.partitionBy(doc).orderBy(pos)
    own = tokens.withColumn("window", F.collect_list(token).over(w.rowsBetween(-width, width - 1))).withColumn("__more", F.count(F.lit(1)).over(w.rowsBetween(width, width)))
    own = own.where((F.size("window") == 2 * width) & (F.col("__more") == 1))
    return (own if labelled is None else own.where(labelled)).select(doc, pos, "window")


def segments(lines: DataFrame, doc: str, pos: str, separator: Column) -> DataFrame:
    """Lines that are no separators, with segment: how many separators stand before them in their document."""
    n = F.sum(separator.cast("int")).over(W.partitionBy(doc).orderBy(pos).rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("segment", n.cast("long")).where(~separator)


def sequence_mask(tokens: DataFrame, doc: str, pos: str, labelled: Column) -> DataFrame:
    """tokens with mask: whether the first token of the sequence has a label, as a sequence is decoded whole or not at all."""
    first = tokens.groupBy(doc).agg(F.min_by(labelled, pos).alias("mask"))
    return tokens.join(first, doc)


def paragraphs(tokens: DataFrame, doc: str, pos: str, ends: Column) -> DataFrame:
    """tokens with paragraph: how many tokens before them in their document end a paragraph."""
    n = F.sum(ends.cast("int")).over(W.partitionBy(doc).orderBy(pos).rowsBetween(W.unboundedPreceding, -1))
    return tokens.withColumn("paragraph", F.coalesce(n, F.lit(0)).cast("long"))


def pad(sequence: Column, length: Column | int, fill: Column) -> Column:
    """An array filled up to a length."""
    return F.concat(sequence, F.array_repeat(fill, F.greatest(F.lit(0), F.lit(length) - F.size(sequence) if isinstance(length, int) else length - F.size(sequence))))


def ordered_split(rows: DataFrame, group: str, order: str, share: float) -> DataFrame:
    """rows with part: train for the first floor(share * n) of each group by order (a long), else dev. Groups may have any size."""
    ranked = rank_in_order(rows, [group], [], order, [])
    n = rows.groupBy(group).agg(F.count("*").alias("__n"))
    return ranked.join(n, group).withColumn("part", F.when(F.col("rank") <= F.floor(share * F.col("__n")), "train").otherwise("dev")).drop("rank", "__n")


def pack_batches(sequences: DataFrame, doc: str, length: str, max_length: int, batch_size: int) -> DataFrame:
    """(doc, partition, batch): greedy packing in order: a batch grows while its longest sequence times one more stays below max_length * batch_size.

    An ordered fold within each partition, as batches need no order between partitions.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = n = longest = 0
        for f in frames:
            out = []
            for x in f["n"]:
                if n and (n >= batch_size or max(longest, x) * (n + 1) >= max_length * batch_size):
                    batch, n, longest = batch + 1, 0, 0
                n, longest = n + 1, max(longest, x)
                out.append(batch)
            yield pd.DataFrame({"id": f["id"], "partition": f["p"], "batch": out})

    kind = dict(sequences.dtypes)[doc]
    rows = sequences.select(F.col(doc).alias("id"), F.col(length).cast("long").alias("n")).sortWithinPartitions("id").withColumn("p", F.spark_partition_id())
    return rows.mapInPandas(run, f"id {kind}, partition int, batch long").withColumnRenamed("id", doc)
