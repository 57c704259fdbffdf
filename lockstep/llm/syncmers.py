"""Document fingerprints from closed syncmers over the units of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockstep.llm.common import let, text_or_empty

#: Units in an anchor, and units in the inner strings whose smallest must lie at an edge.
K, S = 8, 2
#: Texts up to this many code points are cut into characters too, beside words.
SHORT = 512
#: A run without white space counts as several units of at most this many characters.
WORD = "[^\\s]{1,16}"


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of a text: an array of 32-bit hashes, in order.

    Those over words come first and are not negative. Those over characters, of a text of up
    to ``SHORT`` code points, follow and are negative, so texts on either side of that length
    still have words in common.

    A string of ``k`` units is one if the smallest of its inner strings of ``s`` units, by
    hash, is the first or the last of them. That depends on the ``k`` units alone, so an
    edit changes only the anchors that it touches, and at most every ``k - s``-th unit
    passes without one starting. A text of 1 to ``k`` - 1 units has one anchor of all
    of them; one without units has none. Empty and blank texts have no words.
    """
    inner = k - s  # offset of the last inner string

    def low(value: Column) -> Column:
        return value.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    def picked(hashes: Column) -> Column:
        n = F.size(hashes)
        strings = F.transform(F.sequence(F.lit(1), n - (s - 1)), lambda i: F.xxhash64(F.slice(hashes, i, s)))

        def chosen(inside: Column) -> Column:
            at = F.filter(
                F.sequence(F.lit(1), n - (k - 1)),
                lambda i: F.array_min(F.slice(inside, i, inner + 1)).isin(
                    F.get(inside, i - 1), F.get(inside, i - 1 + inner)
                ),
            )
            return F.transform(at, lambda i: low(F.xxhash64(F.slice(hashes, i, k))))

        return (
            F.when(n == 0, F.array().cast("array<int>"))
            .when(n < k, F.array(low(F.xxhash64(hashes))))
            .otherwise(let(strings, chosen))
        )

    def over(pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return let(F.transform(found, lambda u: F.xxhash64(u)), picked)

    characters = F.transform(over("(?s)."), lambda a: a.bitwiseOR(F.lit(-(1 << 31))))
    short = F.when(F.char_length(text) <= SHORT, characters).otherwise(F.array().cast("array<int>"))
    return F.concat(over(WORD), short)


def fingerprint(found: Column) -> Column:
    """Anchors as text: eight hexadecimal digits each, in order; the first digit is 8 or more over characters."""
    return F.array_join(F.transform(found, lambda a: F.lpad(F.hex(a.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Shared distinct anchors by all distinct anchors, 0 to 1; two texts without anchors are alike.

    Two short texts are compared by characters, others by words, which every text is cut into.
    """

    def words_only(found: Column) -> Column:
        return F.exists(found, lambda a: a >= 0) & ~F.exists(found, lambda a: a < 0)

    def of_kind(found: Column) -> Column:
        by_words = words_only(left) | words_only(right)
        return F.when(by_words, F.filter(found, lambda a: a >= 0)).otherwise(F.filter(found, lambda a: a < 0))

    def share(both: Column) -> Column:
        every = F.size(F.array_union(both["left"], both["right"]))
        shared = F.size(F.array_intersect(both["left"], both["right"]))
        return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)

    return let(F.struct(of_kind(left).alias("left"), of_kind(right).alias("right")), share)


def matches(left: Column, right: Column) -> Column:
    """Positional matching: (left, right) indices of each anchor in ``left`` that ``right`` holds too, at its first place there."""
    pairs = F.transform(left, lambda a, i: F.struct(i.alias("left"), (F.array_position(right, a) - 1).alias("right")))
    return F.filter(pairs, lambda p: p["right"] >= 0)


def with_next(rows: DataFrame, key: str, columns: list[str], tie: Column, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``next_<column>`` of the row that follows in descending ``key``; the first follows the last.

    Rows are dealt by ranges of the key, chosen from its counts so that each holds about
    as many. Each range also gets a copy of the next range's first rows, so one shuffle
    does and no task sees more than its range. Null keys come last; equal keys follow in
    order of ``tie``. A table of one row follows itself.

    What goes through the driver are counts of at most 65,536 cells of the key's span.
    Keys that crowd into one cell stay in one range.
    """
    spark = rows.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(F.col(key).cast("long").alias("_key"))
    low, high = keys.agg(F.min("_key"), F.max("_key")).first()
    width = 1 if low is None else max(1, -(-(high - low + 1) // 65_536))
    wide = "decimal(20,0)"  # a span may be beyond 64 bits
    cell = F.coalesce(F.floor((F.col("_key").cast(wide) - F.lit(low or 0).cast(wide)) / F.lit(width)).cast("int"), F.lit(-1))
    counts = keys.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.max("_key").alias("top")).collect()
    counts.sort(key=lambda c: -c["cell"])
    total, so_far, bounds = sum(c["n"] for c in counts), 0, {}
    for c in counts:  # cells of one range in a row, from the largest key down
        bounds.setdefault(so_far * ranges // max(total, 1), []).append(c)
        so_far += c["n"]
    parts = list(bounds.values())
    of_cell = [(c["cell"], i) for i, part in enumerate(parts) for c in part]
    first = [(part[0]["top"], (i - 1) % len(parts)) for i, part in enumerate(parts)]
    cells = spark.createDataFrame(of_cell, "_cell int, _range int")
    copies = spark.createDataFrame(first, "_top bigint, _copy int")
    typed = rows.withColumn("_key", F.col(key).cast("long")).withColumn("_tie", tie).withColumn("_cell", cell)
    # both tables are bounded by the number of cells
    placed = typed.join(F.broadcast(cells), "_cell").join(
        F.broadcast(copies), F.col("_key").eqNullSafe(F.col("_top")), "left"
    )
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy"))
    other = F.struct(F.col("_copy").alias("range"), F.lit(1).alias("copy"))
    dealt = placed.withColumn(
        "_to", F.explode(F.when(F.col("_copy").isNull(), F.array(own)).otherwise(F.array(own, other)))
    ).withColumn("_to_range", F.col("_to.range"))
    order = Window.partitionBy("_to_range").orderBy(F.col("_to.copy"), F.col("_key").desc_nulls_last(), "_tie")
    after = dealt.select(
        *rows.columns, F.col("_to.copy").alias("_is_copy"), *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    )
    return after.where("_is_copy = 0").drop("_is_copy")


def fingerprinted_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and what they have in common.

    The edited text has its last third replaced by the beginning of the next document's.
    Texts are shuffled once, with the anchors found before; there is no Python. Null texts
    are empty.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.withColumn("n", F.char_length("text")).withColumn("found", anchors(F.col("text")))
    rows = with_next(rows, "doc_id", ["text", "found"], F.xxhash64("text"))
    third = F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", "n", "found", "next_found", edited.alias("edited"))
    rows = rows.withColumn("edited_found", anchors(F.col("edited")))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("found")).alias("fingerprint"),
        fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )
