"""Schemas that drift between files: a catalogue of field lifespans, a log of every change, one consistent table.

Each file's footer (its fields, their JSON types and counts) is aggregated from its records. Per producer, field and
type the files that hold it form islands in the producer's file order: ``lag`` finds where an island begins, ``lead``
where it ends. Beginnings and endings that meet in one file are read together: the same field with another type is
retyped; an ending whose values reappear under a beginning, in the records both files hold, is a rename.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.session import materialise

FOOTER_SCHEMA = "file_id bigint, path string, type string, empty boolean, n bigint"
VALUE_SCHEMA = "file_id bigint, side string, rec_key string, path string, value string"
#: Most fields that the consistent table has as columns of their own; beyond that it has one map.
MAX_FIELDS = 2000


def _number(x: float) -> int | float:
    return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x


def leaves(node: object, path: str = "", at: tuple[int, ...] = ()) -> Iterator[tuple[str, str, tuple[int, ...], object]]:
    """(path, type, array positions, value) of every end of a JSON value; nulls and empty objects have none."""
    if isinstance(node, dict):
        for k, v in node.items():
            yield from leaves(v, f"{path}.{k}" if path else str(k), at)
    elif isinstance(node, list):
        inner = [x for x in node if isinstance(x, dict)]
        if inner:
            for i, x in enumerate(node):
                if isinstance(x, dict):
                    yield from leaves(x, path, (*at, i))
        if len(inner) < len(node) or not node:
            yield path, "array" if node else "empty", at, [x for x in node if not isinstance(x, dict)]
    elif isinstance(node, bool):
        yield path, "boolean", at, node
    elif isinstance(node, (int, float)):
        yield path, "number", at, _number(node)
    elif isinstance(node, str):
        yield path, "string", at, node


def _parsed(body: str | None) -> dict | None:
    try:
        root = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return None
    return root if isinstance(root, dict) else None


def _record(body: str | None) -> dict[str, list]:
    """path -> [types, [[positions, value], ...]] of one body; empty if it is no JSON object."""
    root = _parsed(body)
    out: dict[str, list] = {}
    for path, kind, at, value in leaves(root) if root is not None else ():
        entry = out.setdefault(path, [set(), []])
        entry[0].add(kind)
        entry[1].append([at, value])
    return out


def _kinds(node: object, path: str, out: dict[str, set]) -> None:
    """path -> types of every end of a JSON value, as ``leaves`` has them, without the values."""
    if type(node) is str:
        kind = "string"
    elif type(node) is dict:
        for k, v in node.items():
            if v is not None:
                _kinds(v, f"{path}.{k}" if path else k, out)
        return
    elif type(node) is list:
        n = 0
        for x in node:
            if type(x) is dict:
                n += 1
                _kinds(x, path, out)
        if n == len(node) and n:
            return
        kind = "array" if node else "empty"
    elif type(node) is bool:
        kind = "boolean"
    elif node is None:
        return
    else:
        kind = "number"
    held = out.get(path)
    if held is None:
        out[path] = {kind}
    else:
        held.add(kind)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n: Counter = Counter()
        for file_id, body in zip(b["file_id"], b["body"], strict=True):
            found: dict[str, set] = {}
            root = _parsed(body)
            if root is not None:
                _kinds(root, "", found)
            for path, kinds in found.items():
                real = kinds - {"empty"}
                n.update((file_id, path, kind, not real) for kind in real or ("array",))
        yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["file_id", "path", "type", "empty", "n"])


def footers(records: DataFrame) -> DataFrame:
    """(file_id, path, type, empty, n): the fields of files, counted batch by batch before anything is shuffled."""
    return records.select("file_id", "body").filter("file_id is not null").mapInPandas(_count, FOOTER_SCHEMA)


def _digest(values: list) -> str:
    text = json.dumps(values, ensure_ascii=False, sort_keys=True)
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, body, wanted in zip(b["rec_key"], b["body"], b["wanted"], strict=True):
            held = _record(body)
            for pair, side in {(w["pair"], w["side"]) for w in wanted}:
                rows.append((pair, side, key, "", ""))  # the record is there, whatever it holds
            rows += [(w["pair"], w["side"], key, w["path"], _digest(held[w["path"]][1])) for w in wanted if w["path"] in held]
        yield pd.DataFrame(rows, columns=["file_id", "side", "rec_key", "path", "value"])


def restated(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_id, side, rec_key, path, value) of the wanted fields in records that a file and its predecessor both hold.

    ``wanted`` has (read_file, pair, side, path): side ``old`` of a pair is read from the predecessor. Only wanted
    fields leave the parser. Values are digests of all of a field's values with their positions; a record's repeated
    lines count once.
    """
    per_file = wanted.groupBy(F.col("read_file").alias("file_id")).agg(F.collect_list(F.struct("pair", "side", "path")).alias("wanted"))
    read = records.filter("rec_key is not null").select("file_id", "rec_key", "body").join(per_file, "file_id")
    seen = read.select("rec_key", "body", "wanted").mapInPandas(_values, VALUE_SCHEMA)
    per_record = seen.groupBy("file_id", "rec_key").agg(F.collect_set(F.struct("side", "path", "value")).alias("v"), F.count_distinct("side").alias("sides"))
    return per_record.filter("sides = 2").select("file_id", "rec_key", F.inline("v")).filter("path <> ''")


def file_order(files: DataFrame) -> DataFrame:
    """(stream, file_id, seq, prev_file, last): a producer's files by written_at, then file_id."""
    w = Window.partitionBy("stream_name").orderBy(F.col("written_at").asc_nulls_last(), "file_id")
    return files.select(
        F.col("stream_name").alias("stream"), "file_id", F.row_number().over(w).alias("seq"), F.lag("file_id").over(w).alias("prev_file"),
        F.lead("file_id").over(w).alias("next_file"),
    )


def catalogue(found: DataFrame, order: DataFrame) -> DataFrame:
    """All ``footers`` in file order: (stream, seq, file_id, prev_file, next_file, path, type, n_records).

    An empty array counts as a field of type array, unless its producer has fields below that path.
    """
    footer = (
        found.groupBy("file_id", "path", "type")
        .agg(F.sum("n").alias("n_records"), F.bool_and("empty").alias("empty"))
        .join(order, "file_id")
    )
    depth = F.split("path", r"\.")
    above = (
        footer.filter(F.size(depth) > 1)
        .select("stream", F.explode(F.transform(F.sequence(F.lit(1), F.size(depth) - 1), lambda n: F.array_join(F.slice(depth, F.lit(1), n), "."))).alias("path"))
        .distinct()
    )
    return footer.filter("not empty").unionByName(footer.filter("empty").join(above, ["stream", "path"], "left_anti").select(footer.columns)).drop("empty")


def lifespans(cat: DataFrame) -> DataFrame:
    """Catalogue rows with ``starts`` (no such field and type in the preceding file) and ``stops`` (none in the next)."""
    w = Window.partitionBy("stream", "path", "type").orderBy("seq")
    return cat.select(
        "*",
        (F.coalesce(F.lag("seq").over(w), F.lit(-1)) != F.col("seq") - 1).alias("starts"),
        (F.coalesce(F.lead("seq").over(w), F.lit(-1)) != F.col("seq") + 1).alias("stops"),
    )


def islands(cat: DataFrame) -> DataFrame:
    """Lifespans as spans: (stream, path, type, first_seq, last_seq, n_records)."""
    w = Window.partitionBy("stream", "path", "type").orderBy("seq")
    marked = lifespans(cat).withColumn("island", F.sum(F.col("starts").cast("int")).over(w))
    return marked.groupBy("stream", "path", "type", "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("n_records").alias("n_records")).drop("island")


def _digests(side: DataFrame) -> DataFrame:
    """Order-free digest of a field's values over the restated records of a file."""
    return side.groupBy("file_id", "path").agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("rec_key", "value").cast("decimal(38,0)")).alias("h1"),
        F.bit_xor(F.xxhash64("value", F.lit("x"), "rec_key")).alias("h2"),
    )


def _pair_up(group: pd.DataFrame) -> pd.DataFrame:
    """One-to-one renames of a file: among equal values the pair that is a rename elsewhere goes first, then names in order."""
    olds, news, out = set(), set(), []
    for r in group.sort_values(["known", "old_field", "new_field"], ascending=[False, True, True]).itertuples():
        if r.old_field not in olds and r.new_field not in news:
            olds.add(r.old_field)
            news.add(r.new_field)
            out.append((r.file_id, r.old_field, r.new_field))
    return pd.DataFrame(out, columns=["file_id", "old_field", "new_field"])


def changes(records: DataFrame, files: DataFrame) -> DataFrame:
    """Every change of a file against the preceding file of its producer: (file_id, change_kind, old_field, new_field).

    Kinds are ``renamed``, ``added`` (old_field ''), ``removed`` (new_field '') and ``retyped`` (the path in both). A
    producer's first file has none. Bodies that are null or no JSON object hold no fields; repeated lines count once;
    a file without records has lost every field. A rename needs at least one restated record with a value, and equal
    values in all of them. Empty tables give no rows.
    """
    order = file_order(files)
    # The counts of fields are wanted twice, the records are read for them once.
    cat = materialise(lifespans(catalogue(materialise(footers(records)), order)))
    begun = cat.filter("starts and prev_file is not null").select("file_id", "path", "type")
    ended = cat.filter("stops and next_file is not null").select(F.col("next_file").alias("file_id"), "path", "type")
    here = cat.select("file_id", "path").distinct()
    there = cat.filter("next_file is not null").select(F.col("next_file").alias("file_id"), "path").distinct()
    touched = begun.select("file_id", "path").unionByName(ended.select("file_id", "path")).distinct()
    state = (
        touched.join(here.withColumn("now", F.lit(True)), ["file_id", "path"], "left")
        .join(there.withColumn("before", F.lit(True)), ["file_id", "path"], "left")
        .select("file_id", "path", F.col("now").isNotNull().alias("now"), F.col("before").isNotNull().alias("before"))
    )
    state = materialise(state)
    retyped = state.filter("now and before").select("file_id", F.lit("retyped").alias("change_kind"), F.col("path").alias("old_field"), F.col("path").alias("new_field"))
    come, gone = state.filter("now and not before").select("file_id", "path"), state.filter("before and not now").select("file_id", "path")

    pairs = order.filter("prev_file is not null").select("file_id", "prev_file")
    both = come.select("file_id").distinct().join(gone.select("file_id").distinct(), "file_id")
    new = come.join(both, "file_id").select(F.col("file_id").alias("read_file"), F.col("file_id").alias("pair"), F.lit("new").alias("side"), "path")
    old = gone.join(both, "file_id").join(pairs, "file_id").select(F.col("prev_file").alias("read_file"), F.col("file_id").alias("pair"), F.lit("old").alias("side"), "path")
    values = materialise(restated(records, new.unionByName(old)))
    old, new = (values.filter(F.col("side") == side) for side in ("old", "new"))
    same = _digests(old).withColumnRenamed("path", "old_field").join(_digests(new).withColumnRenamed("path", "new_field"), ["file_id", "n", "h1", "h2"])
    same = same.select("file_id", "old_field", "new_field")
    known = same.groupBy("old_field", "new_field").agg(F.count("*").alias("known"))
    renamed = same.join(known, ["old_field", "new_field"]).select("file_id", "old_field", "new_field", "known")
    # Most fields have one counterpart; only files in which some field has several are paired up one by one.
    per_file, per_old, per_new = (Window.partitionBy("file_id", *c) for c in ((), ("old_field",), ("new_field",)))
    several = (F.count("*").over(per_old) > 1) | (F.count("*").over(per_new) > 1)
    renamed = materialise(renamed.withColumn("_several", several).withColumn("_several", F.max("_several").over(per_file)))
    torn = renamed.filter("_several").drop("_several").groupBy("file_id").applyInPandas(_pair_up, "file_id bigint, old_field string, new_field string")
    renamed = materialise(renamed.filter("not _several").select("file_id", "old_field", "new_field").unionByName(torn))
    added = come.join(renamed.select("file_id", F.col("new_field").alias("path")), ["file_id", "path"], "left_anti")
    removed = gone.join(renamed.select("file_id", F.col("old_field").alias("path")), ["file_id", "path"], "left_anti")
    return (
        retyped.unionByName(renamed.select("file_id", F.lit("renamed").alias("change_kind"), "old_field", "new_field"))
        .unionByName(added.select("file_id", F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), F.col("path").alias("new_field")))
        .unionByName(removed.select("file_id", F.lit("removed").alias("change_kind"), F.col("path").alias("old_field"), F.lit("").alias("new_field")))
    )


def aliases(changed: DataFrame, cat: DataFrame) -> dict[tuple[str | None, str], str]:
    """(stream, field) -> the one name of it and of what it was renamed from or to in that stream.

    Only fields that were renamed are listed. Of a stream's names for one field the one holds that most files of all
    streams use, so that streams agree on it. The table has the size of the renames, like the log of changes.
    """
    renamed = changed.filter("change_kind = 'renamed'").join(cat.select("file_id", "stream").distinct(), "file_id").select("stream", "old_field", "new_field").distinct()
    edges = [(r.stream, r.old_field, r.new_field) for r in renamed.collect()]
    named = renamed.select(F.explode(F.array("old_field", "new_field")).alias("path")).distinct()
    uses = {r.path: r.n for r in cat.join(named, "path").groupBy("path").agg(F.countDistinct("file_id").alias("n")).collect()}
    root: dict[tuple, tuple] = {(s, f): (s, f) for s, a, b in edges for f in (a, b)}

    def find(f: tuple) -> tuple:
        while root[f] != f:
            f = root[f]
        return f

    for s, a, b in edges:
        root[find((s, a))] = find((s, b))
    groups: dict[tuple, list[str]] = {}
    for f in root:
        groups.setdefault(find(f), []).append(f[1])
    return {(top[0], f): min(g, key=lambda x: (-uses.get(x, 0), x)) for top, g in groups.items() for f in g}


def named(record: dict[str, list], stream: str | None, name: dict) -> tuple[dict[str, str], list[str]]:
    """field -> text of one record under the fields' one names, and the fields that kept their own.

    Where a record has several fields of one name, the one that bears it, or else the first by name, takes it; the
    others keep theirs, so that no value is lost.
    """
    out: dict[str, str] = {}
    kept: list[str] = []
    for path in sorted(record, key=lambda f: (name.get((stream, f), f) != f, f)):
        found = record[path][1]
        one = found[0][1] if len(found) == 1 and not found[0][0] else [v for _, v in found]
        to = name.get((stream, path), path)
        if to in out:
            kept.append(path)
            to = path
        out[to] = one if isinstance(one, str) else json.dumps(one, ensure_ascii=False)
    return out, kept


def unified(records: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """All records in one table: rec_id, stream_name, file_id, rec_key, conflicts and a column per field under its one name.

    A field has the one name of its renames in its own stream. ``conflicts`` lists the fields of a record that kept their
    own name because another field of the record has the one name already; they have a column of their own, and no
    value is lost. Dots of a path become ``__``. A field that has one type everywhere, outside of arrays, has that type
    (number: double, boolean); any other is string, the JSON text where it is no plain string. With more than MAX_FIELDS
    fields there is one map column ``fields`` instead of a column each. Columns follow from the alias table, so that
    reading is one pass without a shuffle of the bodies.
    """
    order = file_order(files)
    cat = materialise(catalogue(materialise(footers(records)), order))
    name = aliases(changed, cat)
    table = changed.sparkSession.createDataFrame([(s, f, to) for (s, f), to in name.items()], "_stream string, _path string, _to string")
    to = cat.join(table, F.col("stream").eqNullSafe(F.col("_stream")) & (F.col("path") == F.col("_path")), "left").withColumn("name", F.coalesce("_to", "path"))
    # A field that stands in a file beside another of its name may keep its own.
    beside = Window.partitionBy("file_id", "name")
    to = to.withColumn("_beside", F.size(F.collect_set("path").over(beside)) > 1)
    columns = to.select(F.explode(F.when(F.col("_beside"), F.array("name", "path")).otherwise(F.array("name"))).alias("name"), "type").distinct().limit(4 * MAX_FIELDS + 1).collect()
    types: dict[str, set[str]] = {}
    for r in columns:
        types.setdefault(r.name, set()).add(r.type)

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [named(_record(body), stream, name) for body, stream in zip(b["body"], b["stream_name"], strict=True)]
            yield b.drop(columns="body").assign(held=[h for h, _ in out], conflicts=[c for _, c in out])

    read = records.select("rec_id", "file_id", "rec_key", "body").join(files.select("file_id", "stream_name"), "file_id", "left")
    read = read.select("rec_id", "stream_name", "file_id", "rec_key", "body").mapInPandas(values, "rec_id bigint, stream_name string, file_id bigint, rec_key string, held map<string,string>, conflicts array<string>")
    own = ["rec_id", "stream_name", "file_id", "rec_key", "conflicts"]
    if len(types) > MAX_FIELDS:
        return read.select(*own, F.col("held").alias("fields"))
    cast = {frozenset({"number"}): "double", frozenset({"boolean"}): "boolean"}
    cols = [
        F.col("held")[f].try_cast(cast.get(frozenset(types[f]), "string") if "." not in f else "string").alias(f.replace(".", "__"))
        for f in sorted(types)
    ]
    return read.select(*own, *cols)
