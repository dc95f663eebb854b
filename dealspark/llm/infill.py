"""Fill-in-middle transformation by counted quantifiers.

A text is cut into n units, its lines with their ends. Two hashed cuts a <= b of 0 to n give prefix, middle and suffix,
which one match of a pattern made for the row captures: the unit a times, the unit b - a times, the rest. The counted
groups are possessive, so the engine loops over units instead of recursing, and long texts need no deep stack. The same match
writes the output: psm `<P>`prefix`<S>`suffix`<M>`middle or spm `<S>`suffix`<P>`prefix`<M>`middle. Texts that are empty
or hold a marker already, and those that the rate leaves out, stay plain. As no part holds a marker and no marker can
arise across a seam, the output and its form give the text back exactly.

Null text is an empty text (n = 0, plain). A null doc_id is hashed as the empty string. Each row is worked out from its own
doc_id and text alone: repeated rows give equal rows, there are no ties, an empty table gives an empty table, other
columns are ignored. All is Spark expressions; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit: a line with its end, or the last line without one.
UNIT = r"[^\n]*+\n|[^\n]++"
SEED, RATE_PERCENT, SPM_PERCENT = 7, 100, 50


def _chance(k: int) -> Column:
    """The k-th number (from 1) of a row's hash: 8 hexadecimal digits."""
    return F.conv(F.substring("hash", 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, rate_percent: int = RATE_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, text. Returns doc_id, n, form, prefix_chars, middle_chars and output."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("hash"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    one, two = _chance(1) % (F.col("n") + 1), _chance(2) % (F.col("n") + 1)
    marked = F.greatest(*(F.instr("text", m) for m in (PREFIX, SUFFIX, MIDDLE))) > 0
    plain = (F.col("text") == "") | marked | (_chance(3) % 100 >= rate_percent)
    form = F.when(plain, "plain").when(_chance(4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    pattern = F.format_string(rf"\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)((?s:.*+))\z", F.col("a"), F.col("b") - F.col("a"))
    written = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, written))
    rows = rows.select("doc_id", "n", "form", output.alias("output"))
    # markers stand once each, so their places tell how long the parts are
    at_suffix, at_prefix, at_middle = (F.instr("output", m) for m in (SUFFIX, PREFIX, MIDDLE))
    before = F.when(F.col("form") == "psm", at_suffix).when(F.col("form") == "spm", at_middle)
    return rows.select(
        "doc_id",
        "n",
        "form",
        (before - at_prefix - len(PREFIX)).cast("long").alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.char_length("output") - at_middle - (len(MIDDLE) - 1)).cast("long").alias("middle_chars"),
        "output",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13(docs: DataFrame) -> DataFrame:
    rows = transform(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    hashed = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)
