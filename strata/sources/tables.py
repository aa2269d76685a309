"""Silver tables published in versions: layers of open rows by key bucket, closed history apart.

Layout::

    <root>/_ver=<n>/_area=<area>/_bucket=<b>/part-*.parquet
    <root>/_commits/<n>.json                                      manifest

``open`` rows are the current ones (one a key), ``closed`` ones are history.  A write replaces
buckets as a whole, or adds a layer to them: of a key's rows in a bucket's layers the newest
layer's counts, so a change batch writes the keys it changes and no others.  A layer says that a
key has no current row by a ``gone`` row (the last one, with its sequence), and that the key's
earlier closed rows no longer count by a ``void`` row.  :meth:`VersionedTable.compact` makes one
layer of buckets with many.

A manifest says which versions hold each bucket's rows, how many buckets there are and by which
keys, the schema of the table and of each version's files, the last load applied and how far
each stream has come.  A version exists once its manifest does; a write that fails, or that a
``fail`` rule rejects, publishes nothing.  Versions are the table's own count; loads have
numbers of theirs.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.keys import END, START, null_safe_eq, on_keys
from strata.sources import files_store as store
from strata.sources.schemas import aligned, merged

BUCKET, AREA, VERSION = "_bucket", "_area", "_ver"
OPEN, CLOSED, GONE, VOID = "open", "closed", "gone", "void"
# Buckets bound the write parallelism of a full rewrite and the granularity of a partial
# one; size them to the table (about one bucket per GB of open rows).
DEFAULT_BUCKETS = 256
#: Layers of a bucket from which :meth:`VersionedTable.compact` merges them.
LAYERS = 8


def bucket_of(keys: Sequence[str | Column], buckets: int) -> Column:
    """Stable bucket of a key: ``pmod(xxhash64(keys), buckets)`` (names or key expressions)."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


class VersionedTable:
    """One writer at a time is assumed; a second one fails at its commit."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = DEFAULT_BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keys = list(keys)
        self.buckets = buckets
        now = self.manifest()
        if now and (now["buckets"], now["keys"]) != (self.buckets, self.keys):
            raise ValueError(
                f"{self.root}: the table has {now['buckets']} buckets by {now['keys']}, not {self.buckets} by {self.keys}; "
                "open it with these, or change them with rebucket()"
            )

    # -- versions ---------------------------------------------------------------------------
    def versions(self) -> list[int]:
        return list(store.entries(self.spark, f"{self.root}/_commits"))

    def current_version(self) -> int | None:
        numbers = sorted((int(n[:-5]) for n in store.names(self.spark, f"{self.root}/_commits") if n.endswith(".json")), reverse=True)
        return next((n for n in numbers if self.is_committed(n)), None)

    def next_version(self) -> int:
        return (self.current_version() or 0) + 1

    def manifest(self, version: int | None = None) -> dict | None:
        version = self.current_version() if version is None else version
        return None if version is None else store.read_entry(self.spark, f"{self.root}/_commits/{version}.json")

    def exists(self) -> bool:
        return self.current_version() is not None

    def is_committed(self, version: int) -> bool:
        return store.read_entry(self.spark, f"{self.root}/_commits/{version}.json") is not None

    def stream_position(self, stream: str) -> int:
        """The last batch of a stream that is in the published table (-1: none)."""
        return ((self.manifest() or {}).get("streams") or {}).get(stream, -1)

    def last_load(self) -> int:
        """The last load that the published table has taken in (0: none)."""
        return (self.manifest() or {}).get("load", 0)

    def schema(self) -> T.StructType | None:
        """The table's columns as published, without the bucket."""
        man = self.manifest()
        return None if man is None else T.StructType.fromJson(man["schema"])

    # -- reading ----------------------------------------------------------------------------
    def _need(self, version: int | None) -> dict:
        man = self.manifest(version)
        if man is None:
            raise FileNotFoundError(f"{self.root}: no version {'is published' if version is None else version}")
        return man

    def _scan(self, man: dict, held: Mapping[str, Sequence[int]], areas: Iterable[str], buckets: set[int] | None) -> DataFrame:
        """Rows of some areas with area, bucket and version: one scan for each schema that files have."""
        schema = T.StructType.fromJson(man["schema"])
        tech = [T.StructField(VERSION, T.IntegerType()), T.StructField(AREA, T.StringType()), T.StructField(BUCKET, T.IntegerType())]
        by_schema: dict[int, list[str]] = {}
        for b, versions in sorted(held.items(), key=lambda x: int(x[0])):
            if buckets is not None and int(b) not in buckets:
                continue
            for v in versions:
                for area in areas:
                    if int(b) in man["areas"][str(v)].get(area, ()):
                        by_schema.setdefault(man["schema_of"][str(v)], []).append(f"{self.root}/{VERSION}={v}/{AREA}={area}/{BUCKET}={b}")
        whole, out = T.StructType([*schema.fields, *tech]), None
        for i, paths in sorted(by_schema.items()):
            own = T.StructType([*T.StructType.fromJson(man["schemas"][i]).fields, *tech])
            part = aligned(self.spark.read.schema(own).option("basePath", self.root).parquet(*paths), whole)
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], whole) if out is None else out

    def _newest(self, man: dict, buckets: set[int] | None, named: DataFrame | None = None) -> DataFrame:
        """Open and gone rows, with area: each key's row of the newest layer that has it.

        ``named``: only keys that it holds (bucket and keys, each once).  They are picked before layers are compared.
        """
        only = (lambda df: df) if named is None else (lambda df: on_keys(df, named, [BUCKET, *self.keys], "left_semi"))
        split: dict[bool, dict[str, list[int]]] = {False: {}, True: {}}
        for b, versions in man["rows"].items():
            split[len(versions) > 1][b] = versions
        plain = only(self._scan(man, split[False], (OPEN, GONE), buckets).drop(VERSION))
        if not split[True] or not (buckets is None or any(int(b) in buckets for b in split[True])):
            return plain
        layered = only(self._scan(man, split[True], (OPEN, GONE), buckets))
        # a key has at most one row a layer, so its rows are few; whole rows are sorted once, after the shuffle
        by_layer = Window.partitionBy(BUCKET, *self.keys).orderBy(VERSION)
        newest = layered.withColumn("_newer", F.lead(VERSION).over(by_layer)).where(F.col("_newer").isNull()).select(*plain.columns)
        return plain.unionByName(newest) if split[False] else newest

    def _history(self, man: dict, buckets: set[int] | None) -> DataFrame:
        """Closed rows but those that a later layer has made void."""
        closed, voids = self._scan(man, man["closed"], (CLOSED,), buckets), man["voids"]
        if not any(buckets is None or int(b) in buckets for b in voids):
            return closed.drop(VERSION, AREA)
        keys = [F.col(k).alias(f"_vk{i}") for i, k in enumerate(self.keys)]
        void = self._scan(man, voids, (VOID,), buckets).groupBy(F.col(BUCKET).alias("_vb"), *keys).agg(F.max(VERSION).alias("_vv"))
        match = null_safe_eq([closed[k] for k in [BUCKET, *self.keys]], [void["_vb"], *[void[f"_vk{i}"] for i in range(len(keys))]])
        return closed.join(void, match & (closed[VERSION] < void["_vv"]), "left_anti").drop(VERSION, AREA)

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None, closed: bool = True) -> DataFrame:
        """The table as of a published version (default newest); only some buckets, or without closed history, if asked."""
        man = self._need(version)
        wanted = set(buckets) if buckets is not None else None
        rows = self._newest(man, wanted).where(F.col(AREA) == OPEN).drop(AREA)
        return rows.unionByName(self._history(man, wanted)) if closed and man["closed"] else rows

    def read_state(self, buckets: Iterable[int] | None = None, named: DataFrame | None = None) -> DataFrame:
        """Each key's last row: the open one, or the one with which it went (``_area`` tells); of the ``named`` keys only, if given."""
        return self._newest(self._need(None), set(buckets) if buckets is not None else None, named)

    def latest(self, column: str, buckets: Iterable[int] | None = None) -> Column:
        """A value of a column that no key's last row exceeds, as a scalar subquery: the largest in all layers, read from that column alone."""
        man = self._need(None)
        return self._scan(man, man["rows"], (OPEN, GONE), set(buckets) if buckets is not None else None).agg(F.max(column)).scalar()

    def change_feed(self, after: int, upto: int | None = None) -> DataFrame:
        """Row changes that the snapshot versions in ``(after, upto]`` made, from the rows they opened and closed.

        One row per insert and delete, two per update, with ``_change_type`` and ``_commit_version`` (the load's
        id).  Reads what these versions wrote and nothing else; opened and closed rows of a version
        meet by key.  A change confined to untracked columns opens and closes nothing and is no change here.
        """
        last = self.current_version() if upto is None else upto
        found = {v: m for v in range(after + 1, (last or 0) + 1) if (m := self.manifest(v)) and m["at"] is not None and str(v) in m["areas"]}
        newest = self._need(last)
        cols = [f.name for f in T.StructType.fromJson(newest["schema"]).fields if f.name not in (START, END)]
        # manifests tell each version's own files; schemas are those of the newest
        whole = {**newest, "areas": {str(v): m["areas"][str(v)] for v, m in found.items()}}
        whole["schemas"], whole["schema_of"] = [], {}
        for v, m in found.items():
            whole["schema_of"][str(v)] = len(whole["schemas"])
            whole["schemas"].append(m["schemas"][m["schema_of"][str(v)]])
        held: dict[str, list[int]] = {}
        for v, areas in whole["areas"].items():
            for b in {*areas[OPEN], *areas[CLOSED]}:
                held.setdefault(str(b), []).append(int(v))
        rows = self._scan(whole, held, (OPEN, CLOSED), None)
        kind = rows.schema[START].dataType
        known = [x for v, m in found.items() for x in (F.lit(v), F.struct(F.lit(m["at"]).cast(kind).alias("at"), F.lit(m["load"]).cast("int").alias("load")))]
        told = F.element_at(F.create_map(*known), F.col(VERSION)) if known else F.lit(None).cast(f"struct<at:{kind.simpleString()},load:int>")
        rows = rows.withColumn("_told", told)
        side = lambda p: [F.col(VERSION).alias(f"{p}v"), F.col("_told.load").alias(f"{p}load"), F.struct(*[F.col(c) for c in cols]).alias(p)]
        opened = rows.where((F.col(AREA) == OPEN) & (F.col(START) == F.col("_told.at"))).select(*side("new"))
        closed = rows.where(F.col(AREA) == CLOSED).select(*side("old"))
        same = null_safe_eq([F.col(f"old.{k}") for k in self.keys], [F.col(f"new.{k}") for k in self.keys])
        met = closed.join(opened, (F.col("oldv") == F.col("newv")) & same, "full_outer")
        image = lambda p, name: F.struct(*[F.col(f"{p}.{c}").alias(c) for c in cols], F.lit(name).alias("_change_type"))
        both = F.col("oldv").isNotNull() & F.col("newv").isNotNull()
        pre = F.when(both, image("old", "update_preimage")).when(F.col("oldv").isNotNull(), image("old", "delete"))
        post = F.when(both, image("new", "update_postimage")).when(F.col("newv").isNotNull(), image("new", "insert"))
        out = met.select(F.coalesce("oldload", "newload").alias("_commit_version"), F.inline(F.filter(F.array(pre, post), lambda x: x.isNotNull())))
        return out.select(*cols, "_change_type", "_commit_version")

    def with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, bucket_of(self.keys, self.buckets))

    # -- writing ----------------------------------------------------------------------------
    def write(
        self,
        df: DataFrame,
        version: int,
        touched: Iterable[int] | None = None,
        clustered: bool = False,
        closed: Column | None = None,
        layer: bool = False,
        keep_history: bool = True,
    ) -> None:
        """Write ``df`` as ``version``: all buckets, or those ``touched``.  Not visible until :meth:`commit`.

        Rows are clustered by bucket first, so each bucket is one file and not one of every
        task; ``clustered`` says that the plan already does so.  With ``closed`` (a
        predicate), the rows are open ones and such as this version closes: these go to its
        closed history, and the history of earlier versions stays as it is.  A frame with
        an ``_area`` column says itself where rows go.  ``layer``: the rows are added to what
        buckets hold; without ``keep_history`` a bucket's earlier history goes.
        """
        if self.is_committed(version):
            raise ValueError(f"{self.root}: version {version} is already published and immutable")
        told = AREA in df.columns
        if VERSION in df.columns or (told and (closed is not None or not (layer or touched is not None))):
            raise ValueError(f"{self.root}: a column may not be named {VERSION if VERSION in df.columns else AREA}")
        out = df if BUCKET in df.columns else self.with_bucket(df)
        if not clustered:
            out = out.hint("rebalance", BUCKET)  # by bucket, but a bucket too large for one task is split
        if not told:
            out = out.withColumn(AREA, F.lit(OPEN) if closed is None else F.when(closed, F.lit(CLOSED)).otherwise(F.lit(OPEN)))
        out.write.mode("overwrite").partitionBy(AREA, BUCKET).parquet(f"{self.root}/{VERSION}={version}")
        plain = T.StructType([f for f in out.schema if f.name not in (BUCKET, AREA)])
        whole = touched is None and not layer
        self._pending = (version, None if touched is None else set(touched), plain, layer, not whole and keep_history or closed is not None)

    def commit(
        self, version: int, stream: str | None = None, batch: int | None = None, load: int | None = None, digests: Mapping | None = None, at: str | None = None
    ) -> dict:
        """Publish what :meth:`write` wrote; buckets it did not touch stay where they were.

        ``load``: the last load that the version has taken in.  ``digests``: what each bucket's
        source rows amount to, for the next load to compare (none: not known any more).  ``at``: the
        time at which the version's rows were opened and closed, if it was one for all.
        """
        if getattr(self, "_pending", (None,))[0] != version:
            raise ValueError(f"{self.root}: version {version} was not written by this writer")
        _, touched, schema, layer, keep = self._pending
        before = self.manifest() or {"rows": {}, "closed": {}, "voids": {}, "streams": {}, "schemas": [], "schema_of": {}, "areas": {}}
        folder = f"{self.root}/{VERSION}={version}"
        areas = {a: sorted(self._buckets(f"{folder}/{AREA}={a}")) for a in (OPEN, CLOSED, GONE, VOID)}
        held: dict[str, dict[str, list[int]]] = {}
        for part, found in (("rows", {*areas[OPEN], *areas[GONE]}), ("closed", set(areas[CLOSED])), ("voids", set(areas[VOID]))):
            now = {} if touched is None and not layer else dict(before[part])
            if part != "rows" and keep:
                now = dict(before[part])
            elif not layer and touched is not None:
                now = {b: v for b, v in now.items() if int(b) not in touched}
            for b in sorted(found):
                now[str(b)] = [*now.get(str(b), []), version]
            held[part] = now
        schemas, own = list(before["schemas"]), schema.jsonValue()
        if own not in schemas:
            schemas.append(own)
        used = {str(v) for part in held.values() for versions in part.values() for v in versions}
        known = [T.StructType.fromJson(before["schema"])] if "schema" in before and any(v != str(version) for v in used) else []
        man = {
            "version": version,
            "buckets": self.buckets,
            "keys": self.keys,
            "schema": merged([*known, schema]).jsonValue(),
            **held,
            "schemas": schemas,
            "schema_of": {v: i for v, i in (before["schema_of"] | {str(version): schemas.index(own)}).items() if v in used},
            "areas": {v: a for v, a in (before["areas"] | {str(version): areas}).items() if v in used},
            "streams": dict(before["streams"]) | ({stream: batch} if stream is not None else {}),
            "load": before.get("load", 0) if load is None else load,
            "digests": dict(digests or {}),
            "at": at,
        }
        store.write_entry(self.spark, f"{self.root}/_commits/{version}.json", man)
        return man

    def _buckets(self, folder: str) -> set[int]:
        return {int(n.split("=", 1)[1]) for n in store.names(self.spark, folder) if n.startswith(f"{BUCKET}=")}

    def compact(self, layers: int = LAYERS) -> int | None:
        """Make one layer of each bucket that has ``layers`` or more, as the next version; None if there is none."""
        man = self.manifest()
        many = {int(b) for part in ("rows", "closed") for b, v in (man or {}).get(part, {}).items() if len(v) >= layers}
        if not many:
            return None
        rows = self._newest(man, many)
        rows = rows.unionByName(self._history(man, many).withColumn(AREA, F.lit(CLOSED)))
        version = self.next_version()
        self.write(rows, version, touched=many, keep_history=False)
        self.commit(version, digests=man["digests"])
        return version

    def rebucket(self, buckets: int) -> VersionedTable:
        """The table rewritten with another number of buckets, as its next version; loads and streams go on where they were."""
        man = self._need(None)
        rows = self._newest(man, None).unionByName(self._history(man, None).withColumn(AREA, F.lit(CLOSED))).drop(BUCKET)
        version = self.next_version()
        new = object.__new__(VersionedTable)
        new.spark, new.root, new.keys, new.buckets = self.spark, self.root, self.keys, buckets
        # every bucket, old or new, is replaced
        new.write(rows, version, touched=range(max(buckets, self.buckets)), keep_history=False)
        new.commit(version)
        return new
