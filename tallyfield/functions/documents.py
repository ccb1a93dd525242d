"""JSON documents of any shape as VARIANT: canonical text and compaction, in Column functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.sources.shared import saved

#: Levels of nesting that one expression rebuilds; deeper documents are taken apart into rows.
INLINE_LEVELS = 8
DIGITS = 6
_BLANK = r"^(?U)[\s\x1c-\x1f]*$"


def quoted(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def number_text(number: Column) -> Column:
    """A double as canonical JSON: DIGITS decimals at most, whole ones without a point, NULL if not finite."""
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    rounded = F.round(finite, DIGITS)
    small = F.regexp_replace(rounded.cast("string"), r"(\.0)?E-(\d)$", "e-0$2")
    plain = F.regexp_replace(rounded.cast(f"decimal(38,{DIGITS})").cast("string"), r"0+$", "")
    whole = F.when(F.abs(finite) < 1e37, finite.cast("decimal(38,0)").cast("string")).otherwise(finite.cast("string"))
    return F.when(finite == F.floor(finite), whole).when(rounded == 0, "0").when(F.abs(rounded) < 1e-4, small).when(rounded == F.floor(rounded), rounded.cast("decimal(38,0)").cast("string")).otherwise(plain)


def _canonical_scalar(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    number = number_text(v.try_cast("double"))
    content = v.try_cast("binary")
    packed = F.concat(F.lit('{"byte_size":'), F.octet_length(content).cast("string"), F.lit(',"sha256":"'), F.sha2(content, 256), F.lit('"}'))
    scalar = F.when(kind.isin("DOUBLE", "FLOAT"), number).when(kind.startswith("DECIMAL") & ~kind.endswith(",0)"), number).when(kind == "BINARY", packed).otherwise(F.to_json(v))
    return F.coalesce(scalar, F.lit("null"))


def _kept_scalar(v: Column) -> Column:
    """NULL for what is missing, blank or not finite."""
    kind = F.schema_of_variant(v)
    number = v.try_cast("double")
    whole = F.when(F.abs(number) < 1e37, number.cast("decimal(38,0)").cast("string"))
    finite = F.when((number == F.floor(number)) & whole.isNotNull(), whole).when(F.abs(number) < float("inf"), F.to_json(v))
    return F.when(kind == "VOID", None).when(kind == "STRING", F.when(~v.cast("string").rlike(_BLANK), F.to_json(v))).when(kind.isin("DOUBLE", "FLOAT"), finite).otherwise(F.to_json(v))


def _parts(v: Column) -> Column:
    """The parts of an object, by key, or of an array, in order: array of ``head`` and ``part``; NULL for a scalar."""
    fields, items = v.try_cast("map<string,variant>"), v.try_cast("array<variant>")
    by_key = F.array_sort(F.map_entries(fields), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    named = F.transform(by_key, lambda e: F.struct(F.concat(quoted(e["key"]), F.lit(":")).alias("head"), e["value"].alias("part")))
    return F.coalesce(named, F.transform(items, lambda x: F.struct(F.lit("").alias("head"), x.alias("part"))))


def _rebuilt(v: Column, levels: int, scalar: Callable[[Column], Column], empty: bool) -> Column:
    """The text of a VARIANT: keys in code-point order, scalars by ``scalar``, what is NULL left out; NULL if no part is
    left, or with ``empty`` the empty object or array.
    """
    fields, items = v.try_cast("map<string,variant>"), v.try_cast("array<variant>")
    if not levels:
        return F.when(fields.isNotNull() | items.isNotNull(), F.to_json(v)).otherwise(scalar(v))
    body = F.array_join(F.transform(_parts(v), lambda p: F.concat(p["head"], _rebuilt(p["part"], levels - 1, scalar, empty))), ",")
    nested, opening, closing = (F.when(fields.isNotNull(), x).when(items.isNotNull(), y) for x, y in ((True, True), ("{", "["), ("}", "]")))
    # The body stands once in the expression, which so grows with the levels and no faster.
    closed = F.transform(F.array(body), lambda b: F.when(F.lit(empty) | (b != ""), F.concat(opening, b, closing)))
    return F.when(nested, closed[0]).otherwise(scalar(v))


def json_levels(text: Column) -> Column:
    """How deep a JSON text is nested: 0 for a scalar."""
    outside = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    steps = F.split(outside, "")
    deepest = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, x: F.struct((acc["now"] + F.when(x.isin("[", "{"), 1).when(x == "", 0).otherwise(-1)).alias("now"), F.greatest(acc["most"], acc["now"] + F.when(x.isin("[", "{"), 1).otherwise(0)).alias("most")),
        lambda acc: acc["most"],
    )
    return deepest


def _plain(v: Column) -> Column:
    """Whether a VARIANT's own JSON is canonical: it writes sorted keys and no spaces, but numbers and bytes in its own way.

    Its keys are in the order of UTF-16, which is not that of code points if any is beyond the basic plane.
    """
    return ~F.schema_of_variant(v).rlike("DOUBLE|FLOAT|DECIMAL|BINARY|VARIANT") & ~F.to_json(v).rlike(r"[\x{10000}-\x{10FFFF}]|\\u[dD][89abAB]")


def canonical_variant(v: Column, levels: int = 3) -> Column:
    """Canonical JSON of a VARIANT: keys sorted, no spaces, ``number_text``, bytes as size and hash, missing values null (S-12).

    Numbers alike in value are alike in text: 2.0 is 2. What is nested deeper than ``levels`` stays as it is.
    """
    return F.when(_plain(v), F.to_json(v)).otherwise(F.when(v.isNotNull(), _rebuilt(v, levels, _canonical_scalar, True)))


def compact_variant(v: Column, levels: int = 3) -> Column:
    """JSON without nulls, blanks, numbers that are not finite and empty parts; whole doubles become integers (S-16).

    0 and false stay, as does an empty document. What is nested deeper than ``levels`` stays as it is.
    """
    whole = F.when(v.try_cast("map<string,variant>").isNotNull(), "{}").when(v.try_cast("array<variant>").isNotNull(), "[]").otherwise(F.to_json(v))
    return F.coalesce(_rebuilt(v, levels, _kept_scalar, False), F.when(v.isNotNull(), whole))


def _rebuilt_rows(rows: DataFrame, levels: int, scalar: Callable[[Column], Column], empty: bool) -> DataFrame:
    """``_row, _text`` of ``_row, _v``: the documents exploded level by level and put together from the deepest one up.

    A part is named by the places on the way to it, and each level is one group-by of the parts by what holds them. Each
    level is saved, so that the plan of a deep document stays small.
    """
    object_, array = F.col("_v").try_cast("map<string,variant>").isNotNull(), F.col("_v").try_cast("array<variant>").isNotNull()
    opened = F.when(object_, "{").when(array, "[").alias("_open")
    level = rows.select("_row", F.lit("").alias("_path"), F.lit(0).alias("_place"), F.lit("").alias("_head"), F.lit(None).cast("string").alias("_parent"), "_v")
    parts = []
    for _ in range(levels + 1):
        parts.append(level.withColumn("_open", opened))
        inner = level.select("_row", F.col("_path").alias("_parent"), F.posexplode(_parts(F.col("_v"))).alias("_place", "_part"))
        level = saved(inner.select("_row", F.concat_ws("/", "_parent", F.col("_place").cast("string")).alias("_path"), "_place", F.col("_part.head").alias("_head"), "_parent", F.col("_part.part").alias("_v")))
    texts = None
    for one in reversed(parts):
        plain = one.filter(F.col("_open").isNull()).select("_row", "_parent", "_place", F.concat("_head", scalar(F.col("_v"))).alias("_text"))
        held = one.filter(F.col("_open").isNotNull()).select("_row", "_path", "_parent", "_place", "_head", "_open")
        if texts is not None:
            # What is held lies under the holder's own row, which has the place before the first.
            own = held.select("_row", "_path", F.lit(-1).alias("_at"), F.struct("_parent", "_place", "_head", "_open").alias("_holder"), F.lit(None).cast("string").alias("_text"))
            within = texts.select("_row", F.col("_parent").alias("_path"), F.col("_place").alias("_at"), F.lit(None).cast(own.schema["_holder"].dataType).alias("_holder"), "_text")
            body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]), ",")
            closed = own.union(within).groupBy("_row", "_path").agg(F.max_by("_holder", -F.col("_at")).alias("_holder"), body.alias("_body"))
            whole = F.concat("_holder._head", "_holder._open", "_body", F.when(F.col("_holder._open") == "{", "}").otherwise("]"))
            kept = whole if empty else F.when(F.col("_body") != "", whole)
            plain = saved(plain.union(closed.select("_row", "_holder._parent", "_holder._place", kept.alias("_text"))))
        texts = plain
    return texts.select("_row", "_text")


def meaningful(v: Column, levels: int = 2) -> Column:
    """Whether a VARIANT has any part, down to ``levels``, that is neither missing nor blank (S-16)."""
    return _rebuilt(v, levels, _kept_scalar, False).isNotNull() & v.isNotNull()


def is_set(v: Column) -> Column:
    """Whether a VARIANT is there and neither null, false, 0, the empty text nor an empty part."""
    return ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", "false", "0", '""', "[]", "{}")


def _of_table(df: DataFrame, column: str, name: str, scalar: Callable[[Column], Column], empty: bool, form: Callable[[Column, int], Column]) -> DataFrame:
    depth = json_levels(F.col(column))
    deepest = df.agg(F.max(depth)).first()[0] or 0
    near = form(F.try_parse_json(column), min(deepest, INLINE_LEVELS))
    if deepest <= INLINE_LEVELS:
        return df.withColumn(name, near)
    # The rows' own numbers are saved before they are used twice.
    numbered = df.withColumn("_depth", depth).withColumn("_row", F.monotonically_increasing_id())
    deep = saved(numbered.filter(F.col("_depth") > INLINE_LEVELS))
    found = _rebuilt_rows(deep.select("_row", F.try_parse_json(column).alias("_v")).filter(F.col("_v").isNotNull()), deepest, scalar, empty)
    rest = deep.join(found, "_row", "left")
    bare = F.when(F.trim(F.col(column)).startswith("{"), "{}").otherwise("[]")
    text = F.col("_text") if empty else F.coalesce("_text", F.when(F.try_parse_json(column).isNotNull(), bare))
    shallow = df.filter(F.coalesce(depth <= INLINE_LEVELS, F.lit(True))).withColumn(name, near)
    return shallow.union(rest.select(*df.columns, text.alias(name)))


def with_canonical(df: DataFrame, column: str, name: str) -> DataFrame:
    """``name``: the canonical JSON of each text, at any depth; NULL for what is no JSON.

    A text with a key twice, NaN or a lone bracket is no JSON; a lone surrogate becomes ``?``. One pass finds how many
    levels the texts have. Up to INLINE_LEVELS one expression rebuilds them, deeper ones are taken apart into rows.
    """
    return _of_table(df, column, name, _canonical_scalar, True, canonical_variant)


def with_compact(df: DataFrame, column: str, name: str) -> DataFrame:
    """``name``: each JSON text compacted, at any depth; NULL for what is no JSON (see ``with_canonical``)."""
    return _of_table(df, column, name, _kept_scalar, False, compact_variant)
