"""JSON records whose fields drift: rescue-column ingestion and a report of every change between files.

One Arrow pass takes each record's object apart into ``(path, kind, raw, text)`` entries, ``raw`` being the
value's JSON exactly as written. All that follows is columnar SQL over these entries: typed columns of a
target schema, the rescue column with everything unknown or of another kind, promotion of approved fields,
and replay of rescued values into typed columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.session import cut

ENTRY = "array<struct<path: string, kind: string, raw: string, text: string>>"
ENTRY_ARROW = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("raw", pa.string()), ("text", pa.string())]))
#: Kinds of JSON values that a typed column takes without rescue.
ACCEPTS = {
    "int": ("integer",),
    "bigint": ("integer",),
    "double": ("integer", "double"),
    "string": ("string",),
    "boolean": ("boolean",),
}
KINDS = ("integer", "double", "string", "boolean", "array", "object")


class _Number(str):
    """A JSON number as it was written."""

    kind = "integer"


class _Decimal(_Number):
    kind = "double"


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Decimal, parse_constant=_Decimal)


def _raw(value) -> str:
    """JSON text of a decoded value; numbers as written."""
    if isinstance(value, _Number):
        return str.__str__(value)
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_raw(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(_raw, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _entry(path: str, value) -> tuple[str, str | None, str, str | None]:
    if value is None:
        return path, None, "null", None
    if isinstance(value, _Number):
        return path, value.kind, _raw(value), str.__str__(value)
    if isinstance(value, bool):
        return path, "boolean", _raw(value), _raw(value)
    if isinstance(value, str):
        return path, "string", _raw(value), value
    kind = "array" if isinstance(value, list) else "object"
    return path, kind, _raw(value), _raw(value)


def flatten(body: str | None, nested: Sequence[str]) -> list[tuple] | None:
    """Entries of one object; None where ``body`` isn't a JSON object. Of repeated keys the last counts."""
    try:
        top = _DECODER.decode(body) if body is not None else None
    except (ValueError, RecursionError):
        top = None
    if not isinstance(top, dict):
        return None
    out: dict[str, tuple] = {}
    for key, value in top.items():
        if key in nested and (value is None or isinstance(value, dict)):
            for inner, v in (value or {}).items():
                out[f"{key}.{inner}"] = _entry(f"{key}.{inner}", v)
        else:
            out.setdefault(key, _entry(key, value))
    return list(out.values())


def entries(records: DataFrame, keep: Sequence[str], body: str = "body", nested: Sequence[str] = ("params",)) -> DataFrame:
    """``keep`` columns, ``entries`` (null where the body isn't an object) and the ``body`` itself. Map-only."""
    names = [f"_k{i}" for i in range(len(keep))]
    source = records.select(*(records[k].alias(a) for k, a in zip(keep, names)), records[body].alias("_body"))
    kept = "".join(f"{a} {source.schema[a].dataType.simpleString()}, " for a in names)
    nested = tuple(nested)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [flatten(x, nested) for x in batch.column(len(names)).to_pylist()]
            rows = [None if p is None else [dict(zip(("path", "kind", "raw", "text"), e)) for e in p] for p in parsed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, ENTRY_ARROW)], [*names, "_body", "_entries"])

    out = source.mapInArrow(run, f"{kept}_body string, _entries {ENTRY}")
    return out.select(*(F.col(a).alias(k) for k, a in zip(keep, names)), F.col("_entries").alias("entries"), F.col("_body").alias("body"))


def column_name(path: str) -> str:
    return path.replace(".", "_")


def _json_object(items: Column) -> Column:
    """Entries as one JSON object with the values as written; null for no entries."""
    name = lambda e: F.regexp_extract(F.to_json(F.array(e["path"])), r"(?s)^\[(.*)\]$", 1)
    pairs = F.transform(items, lambda e: F.concat(name(e), F.lit(": "), e["raw"]))
    return F.when(F.size(items) > 0, F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))


def _find(items: Column, path: str) -> Column:
    """The entry of a path, or null."""
    return F.get(F.filter(items, lambda e: e["path"] == F.lit(path)), F.lit(0))


def ingest(records: DataFrame, target: Mapping[str, str], keep: Sequence[str], body: str = "body", nested: Sequence[str] = ("params",)) -> DataFrame:
    """Enforce ``target`` (path -> int, bigint, double, string or boolean) on every record.

    Result: ``keep``, a typed column a path (dots become underscores), and ``_rescue``: the entries that the
    schema doesn't know or whose kind the column doesn't take. Nulls and missing fields give null. A body that
    is null or no object gives null columns and comes whole into the rescue under the path ``_body``.
    """
    if clash := {column_name(p) for p in target} & {*keep}:
        raise ValueError(f"columns kept and columns made share names: {sorted(clash)}")
    base = entries(records, keep, body, nested)
    as_json = F.regexp_extract(F.to_json(F.array("body")), r"(?s)^\[(.*)\]$", 1)
    whole = F.array(F.struct(F.lit("_body").alias("path"), F.lit("string").alias("kind"), as_json.alias("raw"), F.col("body").alias("text")))
    items = F.coalesce("entries", F.when(F.col("body").isNotNull(), whole), F.array().cast(ENTRY))
    typed = []
    base = base.withColumn("_items", items)

    def fits(e: Column) -> Column:
        ok = F.lit(False)
        for path, kind in target.items():
            ok = ok | ((e["path"] == path) & e["kind"].isin(*ACCEPTS[kind]) & e["text"].try_cast(kind).isNotNull())
        return ok

    for path, kind in target.items():
        e = _find(F.col("_items"), path)
        typed.append(F.when(e["kind"].isin(*ACCEPTS[kind]), e["text"].try_cast(kind)).alias(column_name(path)))
    rescue = F.filter("_items", lambda e: e["kind"].isNotNull() & ~fits(e))
    return base.select(*keep, *typed, rescue.alias("_rescue"))


def promote(ingested: DataFrame, path: str, kind: str, sources: Sequence[str] = ()) -> DataFrame:
    """Make an approved field a typed column, or fill the one there is, from the rescued values.

    ``sources`` are further paths whose values belong into it (older names of the field), in order of
    preference. A rescued value is cast leniently (``"12"`` fits a number, ``12.0`` an integer); one that
    still does not fit stays in the rescue, as does one whose column already has a value.
    """
    name, rescue = column_name(path), F.col("_rescue")
    now = F.col(name) if name in ingested.columns else F.lit(None).cast(kind)

    def value(text: Column) -> Column:
        plain = F.trim(text)
        if kind in ("int", "bigint"):
            number = plain.try_cast("double")
            return F.coalesce(plain.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))
        if kind == "string":
            return text
        return plain.try_cast(kind)

    scalar = lambda e: ~e["kind"].isin("array", "object")
    found, used = now, F.when(now.isNotNull(), F.lit(""))
    for p in (path, *sources):
        e = _find(rescue, p)
        v = F.when(scalar(e), value(e["text"]))
        used = F.coalesce(used, F.when(v.isNotNull(), F.lit(p)))
        found = F.coalesce(found, v)
    left = F.filter(rescue, lambda e: F.col("_used").isNull() | (e["path"] != F.col("_used")))
    order = [c for c in ingested.columns if c != "_rescue"]
    order += [name] if name not in order else []
    return ingested.withColumn("_used", used).withColumns({name: found, "_rescue": left}).select(*order, "_rescue")


def finish(ingested: DataFrame, name: str = "rescued") -> DataFrame:
    """The rescue column as JSON text, null where nothing was rescued."""
    return ingested.select(*(c for c in ingested.columns if c != "_rescue"), _json_object(F.col("_rescue")).alias(name))


def changes(records: DataFrame, series: str = "series_name", order: str = "file_seq", body: str = "body", nested: Sequence[str] = ("params",)) -> DataFrame:
    """``(series, order, change_kind, old_field, new_field)``: every difference of a file from the one before in its series.

    A file's type of a field is taken over its non-null values; without any, it is that of the file before,
    and at the start of a stay the first one that follows. Fields whose type is never known are only added or
    removed. Records without a place in the order and bodies that aren't objects don't count; repeated and
    unordered records change nothing. The entries are aggregated to one row a file and path before any
    shuffle, so the windows hold files, not records.
    """
    base = entries(records, [series, order], body, nested).where(F.col(order).isNotNull())
    each = base.select(F.col(series).alias("s"), F.col(order).alias("q"), F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("kind"))), F.transform(F.coalesce("entries", F.array().cast(ENTRY)), lambda e: F.struct(e["path"].alias("path"), e["kind"].alias("kind"))))).alias("e"))
    flags = [F.max(F.when(F.col("e.kind") == k, 1).otherwise(0)).alias(f"f_{k}") for k in KINDS]
    per_file = cut(each.groupBy("s", "q", F.col("e.path").alias("path")).agg(*flags), "file-fields")  # used twice: a row a file and path
    n = sum((F.col(f"f_{k}") for k in KINDS), F.lit(0))
    kind = F.when(n == 0, None).when((n == 2) & (F.col("f_integer") == 1) & (F.col("f_double") == 1), "double").when(n > 1, "string")
    for k in KINDS:
        kind = kind.when(F.col(f"f_{k}") == 1, k)
    # the files' order first, over one narrow row a file; then the paths are ranked within their own series and path
    files = per_file.where("path IS NULL").select("s", "q")
    by_series = Window.partitionBy("s").orderBy("q")
    files = files.select(F.col("s").alias("_s"), F.col("q").alias("_q"), F.row_number().over(by_series).alias("r"), F.lead("q").over(by_series).alias("next_q"))
    ranked = per_file.where("path IS NOT NULL").select("s", "q", "path", kind.alias("kind")).join(files, F.col("s").eqNullSafe(F.col("_s")) & (F.col("q") == F.col("_q"))).drop("_s", "_q")
    by_path = Window.partitionBy("s", "path").orderBy("r")
    ranked = ranked.withColumn("stay", F.col("r") - F.row_number().over(by_path))
    stay = Window.partitionBy("s", "path", "stay").orderBy("r")
    known = F.coalesce(F.last("kind", True).over(stay.rowsBetween(Window.unboundedPreceding, 0)), F.first("kind", True).over(stay.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("type", known)
    ranked = ranked.withColumns({"before": F.lag("r").over(stay), "type_before": F.lag("type").over(stay), "behind": F.lead("r").over(stay)})
    parent = F.lit("")
    for p in nested:
        parent = F.when(F.startswith("path", F.lit(f"{p}.")), p).otherwise(parent)
    event = lambda what, q: F.struct(F.lit(what).alias("what"), F.col(q).alias("q"))
    events = F.array(
        F.when(F.col("before").isNull() & (F.col("r") > 1), event("added", "q")),
        F.when(F.col("behind").isNull() & F.col("next_q").isNotNull(), event("removed", "next_q")),
        F.when(F.col("type_before") != F.col("type"), event("retyped", "q")),
    )
    moved = ranked.select("s", "path", "type", parent.alias("parent"), F.explode(F.array_compact(events)).alias("event")).select("s", "event.q", "event.what", "path", "type", "parent")
    one = lambda what: F.count(F.when(F.col("what") == what, 1))
    paths = lambda what: F.collect_list(F.when(F.col("what") == what, F.col("path")))
    grouped = moved.groupBy("s", "q", "parent", "type").agg(one("added").alias("n_new"), one("removed").alias("n_old"), paths("added").alias("new"), paths("removed").alias("old"), paths("retyped").alias("other"))
    renamed = (F.col("n_new") == 1) & (F.col("n_old") == 1) & F.col("type").isNotNull()
    change = lambda what, old, new: F.struct(F.lit(what).alias("change_kind"), old.alias("old_field"), new.alias("new_field"))
    listed = F.when(renamed, F.array(change("renamed", F.get("old", F.lit(0)), F.get("new", F.lit(0))))).otherwise(F.concat(F.transform("old", lambda p: change("removed", p, F.lit(""))), F.transform("new", lambda p: change("added", F.lit(""), p))))
    listed = F.concat(listed, F.transform("other", lambda p: change("retyped", p, p)))
    return grouped.select(F.col("s").alias(series), F.col("q").alias(order), F.explode(listed).alias("c")).select(series, order, "c.*")
