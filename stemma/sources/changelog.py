"""A store of relations as appended changes: small writes, one state for all relations, compaction.

Each commit appends the changed rows of any number of relations as Parquet parts, then one state file names all
parts of all relations. A reader follows one state, so it sees all of a commit or nothing, and a write that fails on the way
leaves the store as it was. State files are created under the next number and never overwritten: of two writers that
started from one state the second fails and can commit again.

Per key the row of the latest part counts; a part may also delete keys. Parts hold a key once. A part whose keys stand in
no earlier part is *apart*: readers add its rows without a join. When other parts are there and the appended rows outgrow a share
of the first part, or when there are many parts, all parts of a relation become one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.session import empty

#: A relation is compacted when its appended rows are more than this share of its first part and some replace others, or when it has
#: more than so many parts.
COMPACT_SHARE, MOST_PARTS = 0.5, 32
DELETED = "_deleted"


@dataclass(frozen=True)
class Relation:
    schema: T.StructType
    keys: tuple[str, ...]


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A semi or anti join on keys that can be null; null equals null."""
    there = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys])
    return left.join(there, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]), how)


@dataclass(frozen=True)
class Written:
    """A part that no state names yet. None of its keys stands in a part of the state ``apart_at``, if there is a number."""

    part: dict
    rows: DataFrame
    apart_at: int | None = None


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since the state was read."""


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


class ChangeLog:
    """Relations by name below one folder."""

    def __init__(self, spark: SparkSession, folder: str, relations: Mapping[str, Relation]):
        self.spark, self.folder, self.relations = spark, folder.rstrip("/"), dict(relations)

    # ---- states -----------------------------------------------------------------

    def state(self) -> tuple[int, dict[str, list[dict]]]:
        """Number of the newest state and the parts of each relation, oldest first."""
        files, states = _hadoop(self.spark, f"{self.folder}/_states")
        if not files.exists(states):
            return 0, {}
        newest = max((s.getPath().getName() for s in files.listStatus(states) if s.getPath().getName().endswith(".json")), default=None)
        if newest is None:
            return 0, {}
        text = self.spark.read.text(f"{self.folder}/_states/{newest}", wholetext=True).first()[0]
        return int(newest.removesuffix(".json")), json.loads(text)

    def _publish(self, number: int, parts: dict[str, list[dict]]) -> None:
        files, path = _hadoop(self.spark, f"{self.folder}/_states/{number:012d}.json")
        try:
            out = files.create(path, False)
        except Exception as error:
            if files.exists(path):
                raise ConcurrentCommit(f"state {number} exists") from error
            raise
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()

    # ---- reading ----------------------------------------------------------------

    def _part(self, name: str, part: dict) -> DataFrame:
        schema = T.StructType([*self.relations[name].schema.fields, T.StructField(DELETED, T.BooleanType())])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{part['folder']}")

    def _current(self, name: str, parts: list[dict]) -> DataFrame:
        keys = list(self.relations[name].keys)
        replacing = [(k, p) for k, p in enumerate(parts) if k and not p.get("apart")]
        first = reduce(DataFrame.unionByName, [self._part(name, p) for k, p in enumerate(parts) if not k or p.get("apart")])
        if not replacing:
            return first
        changes = reduce(DataFrame.unionByName, [self._part(name, p).withColumn("_at", F.lit(k)) for k, p in replacing])
        # Only keys and part numbers are aggregated; a part holds a key once, so key and part name one row.
        newest = changes.groupBy(*keys).agg(F.max("_at").alias("_at"))
        latest = joined(changes, newest, [*keys, "_at"], "left_semi").drop("_at")
        return joined(first, newest, keys, "left_anti").unionByName(latest)

    def read(self, name: str) -> DataFrame:
        """The relation as of the newest state."""
        parts = self.state()[1].get(name)
        if not parts:
            return empty(self.spark, self.relations[name].schema)
        return self._current(name, parts).where(~F.coalesce(DELETED, F.lit(False))).drop(DELETED)

    # ---- writing ----------------------------------------------------------------

    def _codes(self, name: str, parts: list[dict]) -> DataFrame:
        """Hashes of the keys that stand in the parts."""
        keys = self.relations[name].keys
        return reduce(DataFrame.unionByName, [self._part(name, p).select(F.xxhash64(*keys).alias("_code")) for p in parts])

    def met(self, name: str, rows: DataFrame) -> bool:
        """Whether a key of ``rows`` may stand in the newest state, deleted or not; False is certain."""
        return self._met(name, rows, self.state()[1].get(name, []))

    def _met(self, name: str, rows: DataFrame, parts: list[dict]) -> bool:
        """Only hashes of keys are moved, so two keys with one hash count as met."""
        if not parts:
            return False
        codes = rows.select(F.xxhash64(*self.relations[name].keys).alias("_code"))
        return codes.join(self._codes(name, parts), "_code", "left_semi").limit(1).count() > 0

    def written(self, name: str, rows: DataFrame) -> Written:
        """Rows of a coming commit, stored where it leaves them; they can be read before. No state names them yet."""
        part = self._write(name, rows)
        number, parts = self.state()
        own = self._part(name, part)
        met = self._met(name, own, parts.get(name, []))
        return Written(part, own.where(~F.coalesce(DELETED, F.lit(False))).drop(DELETED), None if met else number)

    def _write(self, name: str, rows: DataFrame) -> dict:
        folder = f"p-{uuid.uuid4().hex}"
        names = self.relations[name].schema.fieldNames()
        deleted = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in rows.columns else F.lit(False)
        rows.select(*names, deleted.alias(DELETED)).write.parquet(f"{self.folder}/{name}/{folder}")
        part = {"folder": folder}
        return part | {"rows": self._part(name, part).count()}

    def commit(self, changes: Mapping[str, DataFrame | Written]) -> int:
        """Append changes of several relations as one new state and give its number.

        A row replaces the row of its key, or deletes it where ``_deleted`` is true. Each DataFrame must hold a key once.
        Relations that outgrow their first part are compacted by the same commit. What :meth:`written` gave is not written again; it is
        apart if its keys were new in the very state that this commit follows.
        """
        number, parts = self.state()
        parts = {name: list(known) for name, known in parts.items()}
        for name, rows in changes.items():
            given = rows if isinstance(rows, Written) else self.written(name, rows)
            part, known = given.part, parts.setdefault(name, [])
            if part["rows"]:
                apart = given.apart_at == number
                known.append(part | {"apart": True} if known and apart else part)
            if not known:
                del parts[name]
            replacing = any(not p.get("apart") for p in known[1:])
            if len(known) > MOST_PARTS or replacing and sum(p["rows"] for p in known[1:]) > COMPACT_SHARE * known[0]["rows"]:
                whole = self._current(name, known).where(~F.coalesce(DELETED, F.lit(False)))
                parts[name] = [self._write(name, whole)]
        self._publish(number + 1, parts)
        return number + 1
