"""Ids, labels and formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def typed_id(json: Column) -> Column:
    """struct(numeric, text) of an id's JSON text; 7 and "7" differ; whole numbers lose their fraction."""
    t = F.trim(json)
    is_text = F.startswith(t, F.lit('"'))
    number = F.try_to_number(t, F.lit("S999999999999999D999999"))
    plain = t.try_cast("double")
    whole = (plain == F.floor(plain)) & (F.abs(plain) < 1e15)
    text = F.when(is_text, F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v")).when(whole, plain.try_cast("bigint").cast("string")).otherwise(plain.cast("string"))
    return F.when(is_text | (plain.isNotNull() & number.isNotNull()) | plain.isNotNull(), F.struct((~is_text).alias("numeric"), text.alias("text")))


def id_order(i: Column) -> list[Column]:
    """Numbers first, by value, then texts."""
    return [F.when(i["numeric"], 0).otherwise(1).asc(), F.when(i["numeric"], i["text"].try_cast("double")).asc(), i["text"].asc()]


def type_code(c: Column) -> Column:
    return F.lower(F.trim(c))


def label_type(label: Column) -> Column:
    return F.split_part(label, F.lit("#"), F.lit(1))


def mode(c: Column) -> Column:
    """PLANAR for null or blank, PLANAR or DEPTH in any case, else null (an error)."""
    m = F.upper(F.trim(c))
    return F.when(c.isNull() | (m == ""), "PLANAR").when(m.isin("PLANAR", "DEPTH"), m)


def variant_count(c: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(c, F.lit(3))))


def csv_cell(text: Column, numeric: Column | None = None) -> Column:
    """A cell of a ;-separated file: formulas of text cells are defused, syntax is quoted."""
    plain = F.coalesce(text, F.lit("null"))
    formula = plain.rlike(r"^[\s\p{Z}\p{Cntrl}\x{FEFF}]*[=+\-@]")
    safe = F.when(formula if numeric is None else formula & ~numeric, F.concat(F.lit("'"), plain)).otherwise(plain)
    return F.when(safe.rlike('[;"\n\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def part_count(size: Column, part: Column) -> Column:
    return F.ceil(size / part).cast("bigint")


def part_size(size: Column, part: Column, index: Column) -> Column:
    return F.least(part, size - index * part)


def progress_map(progress: Column) -> Column:
    return F.str_to_map(progress, F.lit("; "), F.lit("="))


def html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def byte_size(c: Column) -> Column:
    tenth = lambda unit: F.floor(c / float(unit) * 10 + 0.5) / 10
    return F.when(c < 1024, F.format_string("%d B", c)).when(c < 1024**2, F.format_string("%.1f KiB", tenth(1024))).otherwise(F.format_string("%.1f MiB", tenth(1024**2)))


def fingerprint(name: Column, size: Column, modified: Column, samples: Column) -> Column:
    """SHA-256 of the JSON list [name, size, modified, sample hashes ...]."""
    body = F.concat(F.lit('["'), name, F.lit('",'), size.cast("string"), F.lit(","), modified.cast("string"), F.lit(',"'), F.array_join(samples, '","'), F.lit('"]'))
    return F.sha2(body, 256)


def attachment_key(chamber: Column, line: Column, x: Column, y: Column) -> Column:
    """The chamber, or the line and the place to the metre."""
    at = lambda c: F.floor(c + 0.5).cast("bigint").cast("string")
    return F.coalesce(chamber.cast("string"), F.concat(line.cast("string"), F.lit(" @"), at(x), F.lit(","), at(y)))


def difference_text(cost_delta: Column, length_delta_m: Column) -> Column:
    """What differs from the best variant; small differences are left out."""
    return F.concat_ws("; ", F.when(F.abs(cost_delta) >= 1, F.format_string("cost %+d", cost_delta.cast("bigint"))), F.when(F.abs(length_delta_m) >= 0.5, F.format_string("length %+d m", F.floor(length_delta_m + 0.5).cast("bigint"))))


def output_id(variant: Column, kind: str, number: Column) -> Column:
    return F.concat(F.lit("v"), variant.cast("string"), F.lit(f"_{kind}_"), number.cast("string"))
