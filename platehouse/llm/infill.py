"""Fill-in-middle by relational units: matches are posexploded, running sums of their lengths place them, cut requests
join them by ordinal, offsets are gathered per document, and substrings of the text are put in their new order.

Units are dealt in two levels, so that few rows are made: first blocks of BLOCK units, all of whose lengths are summed,
then the units of those blocks alone that a cut falls into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units: runs of Latin letters, and every other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Units of a block; a document of n units makes n / BLOCK rows and at most 2 x BLOCK more.
BLOCK = 32
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

_BLOCK = f"(?:[A-Za-z]++|[^A-Za-z]){{1,{BLOCK}}}+"
_MARKERS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"


def _units(text: Column, pattern: str = UNIT) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hash(number: int, key: str = "_hex") -> Column:
    """The number-th group of eight hexadecimal digits, from 1."""
    return F.conv(F.substring(key, 8 * number - 7, 8), 16, 10).cast("long")


def _requests(docs: DataFrame) -> DataFrame:
    """docs with their blocks, number of units, form and the two ordinals at which they are cut (null if plain)."""
    rows = docs.withColumns({"_blocks": _units(F.col("text"), _BLOCK), "_hex": F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)})
    last = F.size(_units(F.element_at("_blocks", -1)))
    rows = rows.withColumn("n", F.when(F.size("_blocks") > 0, (F.size("_blocks") - 1) * BLOCK + last).otherwise(0).cast("long"))
    plain = (F.col("text") == "") | F.col("text").rlike(_MARKERS) | (_hash(3) % 100 >= PLAIN_FROM)
    rows = rows.withColumn("form", F.when(plain, "plain").when(_hash(4) % 100 < SPM_BELOW, "spm").otherwise("psm"))
    cuts = [_hash(i) % (F.col("n") + 1) for i in (1, 2)]
    cut = lambda of: F.when(F.col("form") != "plain", of(*cuts))
    return rows.withColumns({"_first": cut(F.least), "_second": cut(F.greatest)})


def _offsets(docs: DataFrame) -> DataFrame:
    """One row for each _row: n, form, prefix_chars, middle_chars. Everything stays where docs are, dealt by _row."""
    rows = _requests(docs)
    start = F.col("_block") * BLOCK
    cut_here = lambda c: F.coalesce(F.col(c).between(start, start + BLOCK - 1), F.lit(False))
    # Outer: otherwise Catalyst puts a filter below the shuffle, and the text is shuffled once more.
    dealt = rows.select("_row", "_first", "_second", F.posexplode_outer("_blocks").alias("_block", "_piece"))
    dealt = dealt.select("_row", start.alias("_start"), F.char_length("_piece").alias("_chars"), F.when(cut_here("_first") | cut_here("_second"), F.col("_piece")).alias("_piece"))
    before = Window.partitionBy("_row").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.withColumn("_before", F.coalesce(F.sum("_chars").over(before), F.lit(0)))

    # Units of the blocks that a cut falls into, placed by running sums of their lengths.
    inside = Window.partitionBy("_row", "_start").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    units = blocks.where("_piece IS NOT NULL").select("_row", "_start", "_before", F.posexplode(_units(F.col("_piece"))).alias("_pos", "_unit"))
    units = units.select("_row", (F.col("_start") + F.col("_pos")).alias("_ordinal"), (F.col("_before") + F.coalesce(F.sum(F.char_length("_unit")).over(inside), F.lit(0))).alias("_offset"))

    # A request names the unit before which a part ends; ordinal n, the end of the text, meets none.
    wanted = rows.select("_row", "n", "form", F.char_length("text").cast("long").alias("_whole"), F.posexplode(F.array("_first", "_second")).alias("_cut", "_at"))
    met = wanted.alias("w").join(units.alias("u").hint("shuffle_hash"), (F.col("w._row") == F.col("u._row")) & (F.col("_at") <= F.col("_ordinal")) & (F.col("_ordinal") < F.col("_at") + 1), "left")
    ends = [F.max(F.when((F.col("_cut") == i) & F.col("_at").isNotNull(), F.coalesce("_offset", "_whole"))) for i in (0, 1)]
    return met.groupBy("w._row").agg(F.first("n").alias("n"), F.first("form").alias("form"), ends[0].alias("prefix_chars"), (ends[1] - ends[0]).alias("middle_chars"))


def transform(docs: DataFrame) -> DataFrame:
    """Every document in fill-in-middle form: doc_id, text, n, form, prefix_chars, middle_chars, output.

    One shuffle, of doc_id and text by the number of the row; all further joins, windows and sums keep that deal. A null
    text is the empty text, which stays plain; a null doc_id hashes as the empty string; repeated rows stay rows of
    their own; other columns are not read. Row numbers come from the scan, so docs should be a table that reads alike
    each time (a staged one, if it was computed).
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id()).repartition("_row")
    placed = keyed.join(_offsets(keyed).hint("shuffle_hash"), "_row")
    a, b = F.col("prefix_chars"), F.col("prefix_chars") + F.col("middle_chars")
    part = lambda start, length: F.substring(F.col("text"), start.cast("int"), length.cast("int"))
    prefix, middle = part(F.lit(1), a), part(a + 1, F.col("middle_chars"))
    suffix = part(b + 1, F.char_length("text") - b)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return placed.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output: its three parts, cut out between the markers, in their old order. Parts hold no marker."""
    parts = F.split(output, _MARKERS, -1)
    psm, spm = (F.concat(*[F.element_at(parts, i) for i in order]) for order in ((2, 4, 3), (3, 4, 2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """Per document its cuts and the digests of its output and of the text restored from that."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
