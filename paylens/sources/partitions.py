"""Tables cut into partitions: attempts by day, and a keyed merge that rewrites only what it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from paylens.reuse import computed_once
from paylens.sources.files import upsert

DAY = "trans_dt"


# between packed texts, and before what stands for a mark or a missing text
_SEP, _MARK, _PACKED = "\x01", "\x02", "_packed"


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType == StringType() and f.name != DAY]


def _packed(df: DataFrame) -> DataFrame:
    """All texts of a row as one, which takes far fewer bytes to move than a column each."""

    def marked(c: str) -> Column:
        text = F.replace(F.col(c), F.lit(_MARK), F.lit(f"{_MARK}e"))
        text = F.replace(text, F.lit(_SEP), F.lit(f"{_MARK}s"))
        return F.coalesce(text, F.lit(f"{_MARK}n"))

    texts = _texts(df)
    others = [c for c in df.columns if c not in texts]
    return df.select(*others, F.concat_ws(_SEP, *map(marked, texts)).alias(_PACKED))


def _unpacked(packed: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of `like` from `_packed`, texts and missing texts as they were."""
    texts = _texts(like)
    # split once a row, not once a column
    parts = packed.withColumn(_PACKED, F.split(_PACKED, _SEP))

    def text(c: str) -> Column:
        part = F.get(F.col(_PACKED), F.lit(texts.index(c)))
        plain = F.replace(part, F.lit(f"{_MARK}s"), F.lit(_SEP))
        plain = F.replace(plain, F.lit(f"{_MARK}e"), F.lit(_MARK))
        return F.when(part != f"{_MARK}n", plain).alias(c)

    return parts.select(*[text(c) if c in texts else F.col(c) for c in like.columns])


def write_days(txn: DataFrame, path: str) -> None:
    """Attempts as one folder a day.

    Rows are gathered by day first, so that a day is few files; a day above the
    advisory partition size is spread over several tasks. The texts of a row are
    packed while it is moved and sorted.
    """
    gathered = _packed(txn).hint("rebalance", F.col(DAY)).sortWithinPartitions(DAY)
    _unpacked(gathered, txn).write.partitionBy(DAY).parquet(path)


def read_days(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The attempts of `write_days`; a range of days reads the folders of these days only."""
    return spark.read.schema(schema).parquet(path)


def _name(column: str) -> Column:
    """A partition's name: the value as text, safe in a path."""
    return F.coalesce(F.concat(F.lit("v-"), F.url_encode(F.col(column).cast("string"))), F.lit("null"))


class PartitionedTable:
    """A parquet table whose partitions are named by the newest manifest.

    A merge writes new files for the partitions that hold staged keys and then
    one manifest that lists them next to the untouched ones. Readers see the
    table before or after it, never between; a merge that fails, or that another
    one has overtaken, leaves nothing but files nobody lists.
    """

    def __init__(self, spark: SparkSession, root: str, column: str) -> None:
        self.spark, self.root, self.column = spark, root.rstrip("/"), column

    def version(self) -> int:
        """Number of the newest manifest; 0 before the first merge."""
        path = self._path("manifests")
        if not self._fs().exists(path):
            return 0
        names = [f.getPath().getName() for f in self._fs().listStatus(path)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def folders(self, version: int | None = None) -> dict[str, str]:
        """Partition name to folder."""
        return self._manifest(version)[0]

    def read(self, names: Sequence[str] | None = None, version: int | None = None) -> DataFrame | None:
        """The table, or its partitions `names`; None if there are none."""
        folders, schema = self._manifest(version)
        kept = [f for n, f in folders.items() if names is None or n in names]
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in kept]) if kept else None

    def merge(self, staging: DataFrame, keys: Sequence[str]) -> int:
        """`upsert` of the staged rows, partition by partition; the new version's number.

        A staged row may lie in another partition than the row it replaces; both
        are rewritten then.
        """
        before = self.version()
        staged = computed_once(staging)
        old = self.read(version=before)
        touched = staged.select(_name(self.column).alias("name"))
        if old is not None:
            hit = old.join(staged.select(*keys).distinct(), list(keys), "left_semi")
            touched = touched.unionByName(hit.select(_name(self.column).alias("name")))
        # as many as the table has partitions, at the most
        names = {r["name"] for r in touched.distinct().collect()}
        target = self.read(names, before) if before else None
        data = f"data/{before + 1:06d}-{uuid.uuid4().hex[:8]}"
        fresh = upsert(target, staged, list(keys)).withColumn("_part", _name(self.column))
        fresh.hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(f"{self.root}/{data}")
        written = [f.getPath().getName() for f in self._fs().listStatus(self._path(data)) if f.isDirectory()]
        # the writer escapes the percent signs of the encoding once more
        new = {self._unescaped(n.removeprefix("_part=")): f"{data}/{n}" for n in written}
        kept = {n: f for n, f in self.folders(before).items() if n not in names} if before else {}
        self._commit(before + 1, {**kept, **new}, staged.schema)
        return before + 1

    def _manifest(self, version: int | None) -> tuple[dict[str, str], StructType]:
        version = self.version() if version is None else version
        if not version:
            return {}, StructType()
        text = self.spark.read.text(f"{self.root}/manifests/{version:06d}.json", wholetext=True).first()[0]
        found = json.loads(text)
        return found["folders"], StructType.fromJson(found["schema"])

    def _commit(self, version: int, folders: dict[str, str], schema: StructType) -> None:
        """The manifest appears under its name at once, or not at all if the name is taken."""
        jvm = self.spark._jvm
        text = json.dumps({"folders": folders, "schema": schema.jsonValue()})
        hidden, shown = (self._path(f"manifests/{n}") for n in (f".{uuid.uuid4().hex}.tmp", f"{version:06d}.json"))
        out = self._fs().create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), self._conf())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            files.rename(hidden, shown, options)
        except Exception as taken:
            raise RuntimeError(f"version {version} was written by another merge") from taken

    @staticmethod
    def _unescaped(name: str) -> str:
        return name.replace("%25", "%")

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self._conf()).makeQualified(path)

    def _fs(self):
        return self._path("").getFileSystem(self._conf())
