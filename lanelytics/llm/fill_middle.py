"""Fill-in-middle transformation by counted quantifiers: one match cuts a text into prefix, middle and suffix.

``regexp_count`` gives the n units of a text.  Two hashes of the document's id
choose the ends of prefix and middle, a <= b, and a pattern made for the row,
with the possessive groups ``unit{a}`` and ``unit{b - a}``, captures the three
parts in a single match, which the replacement puts in order.  Possessive
quantifiers of a fixed count keep no way back, so neither time nor stack grows
with more than the length of the text.

A text is left plain if it is empty, holds a marker (so that a document can
always be rebuilt from its output) or by the share of plain documents; of the
others, a share has its suffix in front.  Null texts count as empty; a null id
counts as empty text in the hash.  Every row gives one row, rows with the same
id and text the same one; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.llm.common import whole_text

#: A code point, line ends included.
CODE_POINT = r"(?s:.)"
#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Units that are counted at a time, so that a long text gives few matches.
BLOCK = 1024


def unit_count(text: Column, unit: str = CODE_POINT) -> Column:
    """How often a unit matches from left to right in a text that its matches cover: whole blocks, then the rest."""
    block = f"(?:{unit}){{{BLOCK}}}+"
    rest = F.regexp_replace(text, F.lit(rf"\A(?:{block})*+"), F.lit(""))
    return (F.lit(BLOCK) * F.regexp_count(text, F.lit(block)) + F.regexp_count(rest, F.lit(unit))).cast("long")


def id_hashes(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """The first eight-digit groups of the hex sha256 of seed, colon and id, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(count)]


def _quoted(marker: str) -> str:
    """The marker as part of a replacement."""
    return marker.replace("\\", "\\\\").replace("$", "\\$")


def _in_pattern(marker: str) -> str:
    """The marker as part of a pattern."""
    return re.sub(r"(\W)", r"\\\1", marker)


def transform(
    docs: DataFrame,
    seed: int = 1,
    plain_percent: int = 10,
    suffix_first_percent: int = 20,
    unit: str = CODE_POINT,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs (doc_id, text).

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); the sizes are in units.
    """
    h1, h2, h3, h4 = id_hashes(F.col("doc_id"), seed)
    counted = docs.select("doc_id", whole_text()).select("doc_id", "text", unit_count(F.col("text"), unit).alias("n"))
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains("text", F.lit(marker))
    ends = [h % (F.col("n") + 1) for h in (h1, h2)]
    form = (
        F.when((F.col("n") == 0) | marked | (h3 % 100 >= 100 - plain_percent), "plain")
        .when(h4 % 100 < suffix_first_percent, "spm")
        .otherwise("psm")
    )
    cut = counted.select(
        "doc_id", "text", "n", form.alias("form"), F.least(*ends).alias("a"), F.abs(ends[0] - ends[1]).alias("size")
    )
    of = lambda count: F.concat(F.lit(f"((?:{unit}){{"), F.col(count).cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), of("a"), of("size"), F.lit(r"((?s:.)*+)\z"))
    prefix, suffix, middle = map(_quoted, markers)
    order = F.when(F.col("form") == "psm", f"{prefix}$1{suffix}$3{middle}$2").otherwise(f"{suffix}$3{prefix}$1{middle}$2")
    known = F.col("form") != "plain"
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.when(known, F.col("a")).alias("prefix_chars"),
        F.when(known, F.col("size")).alias("middle_chars"),
        F.when(known, F.regexp_replace("text", pattern, order)).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that gave an output: each marker stands in it once, in the order of its form."""
    prefix, suffix, middle = map(_in_pattern, markers)
    part = "((?s:.)*?)"
    rebuilt = lambda pattern, order: F.regexp_replace(output, F.lit(rf"\A{pattern}((?s:.)*+)\z"), F.lit(order))
    return (
        F.when(form == "psm", rebuilt(f"{prefix}{part}{suffix}{part}{middle}", "$1$3$2"))
        .when(form == "spm", rebuilt(f"{suffix}{part}{prefix}{part}{middle}", "$2$3$1"))
        .otherwise(output)
    )


def digests(docs: DataFrame) -> DataFrame:
    """The transformation of every row with digests of its output and of the text rebuilt from that."""
    cut = transform(docs)
    return cut.select(
        *cut.columns[:-1],
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
