"""Relations of recordings kept in versions, so that what belongs together changes together.

A commit writes the rows of the recordings it touches aside, as one part of each relation, with the list of those
recordings; then it publishes a version, a small file that names all parts.  Rows of a recording that a later part touches no
longer count: the list is the delete marker.  Readers hold a version and see nothing of a commit before it is
published, or of one that failed; what failed leaves unnamed parts, which ``vacuum`` removes.  ``compact`` writes each relation
as one part again.

A part is Parquet in ranges of its order, and the least and greatest value of its leading column in each file are kept
beside it, so a reader that wants some values opens only the files that may hold them.  One writer at a time: of two that
start from one version the second fails when it publishes.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TOUCHED = "touched"


class Folder:
    """Small files of a folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self._conf), p

    def names(self, name: str) -> list[str]:
        fs, p = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, name: str) -> str:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The whole file or none; an error if there is one already."""
        fs, p = self._at(name)
        aside = p.suffix(f".{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(aside, p):
            fs.delete(aside, False)
            raise FileExistsError(f"{p} is there already: another commit came first")

    def remove(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)


class Snapshots:
    """``orders``: by relation, the columns that its files are ranged and sorted by; the first one can be pruned by."""

    def __init__(self, spark: SparkSession, root: str, orders: Mapping[str, Sequence[str]], key: str = "rec_id"):
        self.spark, self.root, self.orders, self.key = spark, root.rstrip("/"), dict(orders), key
        self.folder = Folder(spark, root)
        self._files: dict[str, list] = {}

    # ---- versions

    def version(self) -> dict:
        """The newest published version; an empty one before any."""
        done = [n for n in self.folder.names("versions") if n.endswith(".json")]
        return json.loads(self.folder.read(f"versions/{done[-1]}")) if done else {"number": 0, "commits": [], "parts": {}, "notes": {}}

    def _publish(self, version: dict) -> dict:
        self.folder.publish(f"versions/{version['number']:012d}.json", json.dumps(version))
        return version

    def commit(self, changes: Mapping[str, DataFrame | Callable], touched: DataFrame, notes: Callable[[dict, str], dict] | None = None) -> dict:
        """Replace everything that the recordings in ``touched`` have by their rows in ``changes`` (none: they are deleted).
        A change may be a function of the relations that this commit has written before it, by name, so that what is made of
        the segments reads them back and does not make them again.  ``notes`` makes the new version's notes from the old version and the commit's name, once its parts are written."""
        old, name = self.version(), uuid.uuid4().hex
        touched.select(self.key).distinct().write.parquet(self._path(name, TOUCHED))
        for relation, rows in changes.items():
            self._write(name, relation, rows(lambda r: self.written(name, r)) if callable(rows) else rows)
        parts = {r: [*old["parts"].get(r, []), *([name] if r in changes else [])] for r in {*old["parts"], *changes}}
        return self._publish({"number": old["number"] + 1, "commits": [*old["commits"], name], "parts": parts, "notes": notes(old, name) if notes else old["notes"]})

    def compact(self) -> dict:
        """The same rows as one part of each relation, without markers."""
        old, name = self.version(), uuid.uuid4().hex
        for relation in old["parts"]:
            self._write(name, relation, self.read(relation, old))
        return self._publish({"number": old["number"] + 1, "commits": [], "parts": {r: [name] for r in old["parts"]}, "notes": old["notes"]})

    def vacuum(self, keep: int = 1) -> None:
        """Remove versions but the newest ``keep``, and parts that no version left names."""
        names = [n for n in self.folder.names("versions") if n.endswith(".json")]
        held = [json.loads(self.folder.read(f"versions/{n}")) for n in names[-keep:]]
        used = {p for v in held for p in (*v["commits"], *(x for ps in v["parts"].values() for x in ps))}
        for n in names[:-keep]:
            self.folder.remove(f"versions/{n}")
        for p in set(self.folder.names("parts")) - used:
            self.folder.remove(f"parts/{p}")

    # ---- parts

    def _path(self, commit: str, relation: str) -> str:
        return f"{self.root}/parts/{commit}/{relation}"

    def _write(self, commit: str, relation: str, rows: DataFrame) -> None:
        order = list(self.orders.get(relation, (self.key,)))
        path = self._path(commit, relation)
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
        ranges = self.spark.read.schema(rows.schema).parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min(order[0]).alias("low"), F.max(order[0]).alias("high"), F.count(F.lit(1)).alias("n"))
        listed = [[r["f"].rsplit("/", 1)[-1], r["low"], r["high"], r["n"]] for r in ranges.collect()]  # one row a file
        self.folder.publish(f"parts/{commit}/{relation}.json", json.dumps({"files": listed, "schema": rows.schema.json()}))

    def written(self, commit: str, relation: str) -> DataFrame:
        """What a commit has written of a relation, published or not."""
        return self.spark.read.parquet(self._path(commit, relation))

    def _part(self, commit: str, relation: str) -> dict:
        name = f"parts/{commit}/{relation}.json"
        if name not in self._files:
            self._files[name] = json.loads(self.folder.read(name))
        return self._files[name]

    def rows_within(self, relation: str, version: dict, within: Sequence[tuple]) -> int:
        """Rows of the files that ``read`` would open, known without opening them."""
        return sum(n for name in version["parts"].get(relation, []) for _, low, high, n in self._part(name, relation)["files"] if any(low <= b and high >= a for a, b in within))

    def read(self, relation: str, version: dict | None = None, within: Sequence[tuple] | None = None) -> DataFrame:
        """Rows of a relation in a version (the newest).  ``within`` are ranges (least, greatest) of its leading column: only
        files that may hold a value in one of them are opened; rows outside the ranges may still be among those."""
        from pyspark.sql.types import StructType

        version = version or self.version()
        after = {name: i for i, name in enumerate(version["commits"])}
        out = []
        for name in version["parts"].get(relation, []):
            part = self._part(name, relation)
            files = [f for f, low, high, _ in part["files"] if within is None or any(low <= b and high >= a for a, b in within)]
            reader = self.spark.read.schema(StructType.fromJson(json.loads(part["schema"])))
            rows = reader.parquet(*[f"{self._path(name, relation)}/{f}" for f in files]) if files else self.spark.createDataFrame([], StructType.fromJson(json.loads(part["schema"])))
            out.append(rows.withColumn("__commit", F.lit(after.get(name, -1))))
        if not out:
            raise LookupError(f"no part of {relation} in version {version['number']}")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
        later = [c for c in version["commits"] if after[c] > min(after.get(p, -1) for p in version["parts"][relation])]
        if later:
            marks = reduce(DataFrame.unionByName, [self.spark.read.schema(rows.select(self.key).schema).parquet(self._path(c, TOUCHED)).withColumn("__last", F.lit(after[c])) for c in later])
            last = marks.groupBy(self.key).agg(F.max("__last").alias("__last"))
            rows = rows.join(last, (rows[self.key] == last[self.key]) & (rows["__commit"] < last["__last"]), "left_anti")
        return rows.drop("__commit")


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that all executors share (``spark.checkpoint.dir``), or on a single machine in one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="jatoba-")
    return f"{named.rstrip('/')}/kept-{uuid.uuid4().hex}"


def between(column: Column, within: Sequence[tuple]) -> Column:
    """The condition that prunes row groups inside the files that are opened."""
    return reduce(Column.__or__, [(column >= F.lit(a)) & (column <= F.lit(b)) for a, b in within], F.lit(False))
