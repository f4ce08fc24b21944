"""A table that takes writes: segments by key bucket, deletion vectors, and a log that can't lose a writer.

``folder/log/<number>.json`` is the state after a change: which segments and deletion vectors count.  A
change writes its own files first and then creates the next number.  Creating a file that exists fails, so of two
writers from one state the second gets a ``Conflict``, or tries again on the first one's state.

``folder/data/_seq=n/_writer=x/_bucket=b`` holds the rows that change n wrote, ``folder/dead/_upto=n/...`` the keys whose rows
of earlier changes it replaced or deleted.  A read takes the rows of a segment but those dead since, so a change
costs what it writes and one look at the keys.  ``compact`` puts small segments together, ``vacuum`` deletes what no kept state names.

Keys aren't null.  Of rows of one key in one change the last counts: by ``order``, else by the place in the frame.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Deletions that are broadcast at most, by the number in the state; more are joined by a shuffle.
FEW_DEAD = 200_000
SEQ, WRITER, BUCKET, UPTO = "_seq", "_writer", "_bucket", "_upto"


class Conflict(RuntimeError):
    """Another writer changed the table from the same state."""


class Log:
    """Numbered states as files; each number is given once."""

    #: A claimed number whose state isn't there yet is waited for, and void after so many seconds.
    PATIENCE = 30.0

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number:012d}.json")

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.path):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def get(self, number: int) -> dict | None:
        """The state; None while, or if, its writer hasn't finished it."""
        stream = self.fs.open(self._at(number))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def last(self) -> tuple[int, int, dict | None]:
        """The highest number that is claimed, the highest that has a state, and that state."""
        numbers = self.numbers()
        top = numbers[-1] if numbers else 0
        for n in reversed(numbers):
            while (state := self.get(n)) is None and time.time() - self.fs.getFileStatus(self._at(n)).getModificationTime() / 1000 < self.PATIENCE:
                time.sleep(0.1)
            if state is not None:
                return top, n, state
        return top, 0, None

    def commit(self, number: int, state: dict) -> None:
        """Make ``state`` the one of ``number``; Conflict if the number is given already."""
        path = self._at(number)
        try:
            if self.fs.getUri().getScheme() == "file":
                # Hadoop's local files have no atomic creation of their own
                jvm = self.spark._jvm
                self.fs.mkdirs(self.path)
                none = self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
                kinds = self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
                jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(path.toUri().getPath(), none), kinds)
                out = self.fs.create(path, True)
            else:
                out = self.fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"another writer made change {number} of {self.folder}") from e
            raise
        out.write((json.dumps(state) + "\n").encode())
        out.close()

    def forget(self, number: int) -> None:
        self.fs.delete(self._at(number), False)


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, keys: list[str], buckets: int = 16, most_segments: int = 12, small_bytes: int = 64 << 20) -> None:
        """``buckets``: into how many parts keys are dealt, fixed by the first change.  Segments under ``small_bytes`` are put
        together once there are ``most_segments`` of them."""
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        if own := {SEQ, WRITER, BUCKET, UPTO} & {n.lower() for n in self.schema.names}:
            raise ValueError(f"names of the table's own: {sorted(own)}")
        self.log, self.most_segments, self.small_bytes = Log(spark, f"{self.folder}/log"), most_segments, small_bytes
        self._buckets = buckets

    # --- states

    def _state(self) -> tuple[int, int, dict]:
        top, number, state = self.log.last()
        return top, number, state or {"segments": [], "dead": [], "rows": 0, "buckets": self._buckets}

    def version(self) -> int:
        return self.log.last()[1]

    def _bucket(self, state: dict, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(state["buckets"])).cast("int")

    # --- reading

    def _scan(self, kind: str, names: list[str], schema: StructType, numbered: str) -> DataFrame:
        whole = StructType(list(schema.fields)).add(numbered, IntegerType()).add(BUCKET, IntegerType())
        return self.spark.read.schema(whole).option("basePath", f"{self.folder}/{kind}").parquet(*[f"{self.folder}/{kind}/{n}" for n in names])

    def _live(self, state: dict, segments: list[dict] | None = None, only_keys: bool = False) -> DataFrame:
        """Rows that count, with their bucket, of all segments or some."""
        segments = state["segments"] if segments is None else segments
        schema = StructType([f for f in self.schema.fields if not only_keys or f.name in self.keys])
        if not segments:
            return self.spark.createDataFrame([], StructType(list(schema.fields)).add(BUCKET, IntegerType()))
        rows = self._scan("data", [s["name"] for s in segments], schema, SEQ)
        least = min(s["seq"] for s in segments)
        dead = [d for d in state["dead"] if d["upto"] > least]
        if dead:
            keys = StructType([self.schema[k] for k in self.keys])
            gone = self._scan("dead", [d["name"] for d in dead], keys, UPTO).groupBy(BUCKET, *self.keys).agg(F.max(UPTO).alias(UPTO))
            gone = F.broadcast(gone) if sum(d["rows"] for d in dead) <= FEW_DEAD else gone
            rows = rows.join(gone, [BUCKET, *self.keys], "left").where(F.col(UPTO).isNull() | (F.col(SEQ) >= F.col(UPTO)))
        return rows.select(*schema.names, BUCKET)

    def rows(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was after an earlier change that is still kept."""
        state = self._state()[2] if version is None else self.log.get(version)
        return self._live(state).drop(BUCKET)

    def get(self, *key: object) -> DataFrame:
        """The row of a key; only its bucket is read."""
        state = self._state()[2]
        kinds = [self.schema[k].dataType for k in self.keys]
        typed = [F.lit(v).cast(t) for v, t in zip(key, kinds, strict=True)]
        rows = self._live(state).where(F.col(BUCKET) == self._bucket(state, *typed))
        for name, v in zip(self.keys, typed, strict=True):
            rows = rows.where(F.col(name) == v)
        return rows.drop(BUCKET)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """``ids`` (keys and more) with the rows of those keys that are there."""
        state = self._state()[2]
        return ids.withColumn(BUCKET, self._bucket(state, *[F.col(k) for k in self.keys])).join(self._live(state), [BUCKET, *self.keys]).drop(BUCKET)

    def count(self) -> int:
        return self._state()[2]["rows"]

    def files(self) -> dict:
        """What the table holds: change, rows, segments, deletions, bytes."""
        _, number, state = self._state()
        return {"version": number, "rows": state["rows"], "segments": len(state["segments"]), "dead": sum(d["rows"] for d in state["dead"]), "bytes": sum(s["bytes"] for s in state["segments"] + state["dead"])}

    # --- writing

    def _write(self, rows: DataFrame, place: str) -> dict | None:
        """Rows with their bucket, written; None if there are none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{place}")
        rows.write.partitionBy(BUCKET).parquet(f"{self.folder}/{place}")
        own = self.log.fs.getContentSummary(path)
        found = self.spark.read.schema(f"{BUCKET} int").parquet(f"{self.folder}/{place}").count() if own.getFileCount() > 1 else 0
        if not found:
            self.log.fs.delete(path, True)
            return None
        return {"name": place.split("/", 1)[1], "rows": found, "bytes": own.getLength()}

    def _spread(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows of a key together, buckets apart, as many tasks as the session's shuffle partitions."""
        keys = [F.col(k) for k in self.keys]
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // state["buckets"])
        salt = F.pmod(F.xxhash64(*keys, F.lit("file")), F.lit(parts)).alias("_part")
        return rows.withColumn(BUCKET, self._bucket(state, *keys)).repartition(parts * state["buckets"], BUCKET, salt)

    def _move(self, kind: str, entry: dict, column: str, number: int) -> dict:
        """A written part under the number of its change."""
        name = f"{column}={number}/{entry['name'].split('/', 1)[1]}"
        if name != entry["name"]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            self.log.fs.mkdirs(path(f"{self.folder}/{kind}/{column}={number}"))
            if not self.log.fs.rename(path(f"{self.folder}/{kind}/{entry['name']}"), path(f"{self.folder}/{kind}/{name}")):
                raise RuntimeError(f"{entry['name']} can't be moved")
        return entry | {"name": name}

    def _change(self, make: Callable[[int, int, dict], dict | None], tries: int) -> dict:
        """Commit what ``make`` makes of the state, again on the new state after a conflict."""
        for left in range(tries - 1, -1, -1):
            top, number, state = self._state()
            new = make(top + 1, number, state)
            if new is None:
                return state
            try:
                self.log.commit(top + 1, new)
                return new
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def _killed(self, wanted: DataFrame, number: int, state: dict) -> dict | None:
        """The deletion vector of the live keys that are in ``wanted`` (bucket, keys)."""
        if not state["segments"]:
            return None
        gone = self._live(state, only_keys=True).join(wanted, [BUCKET, *self.keys], "left_semi")
        entry = self._write(gone, f"dead/{UPTO}={number}/{WRITER}={uuid.uuid4().hex}")
        return entry and entry | {"upto": number}

    def upsert(self, rows: DataFrame, order: list[Column] | None = None, tries: int = 5) -> dict:
        """Add rows and replace those of equal keys: {rows, replaced}.  Columns that ``rows`` lacks are null."""
        _, number, state = self._state()
        have = {c.lower() for c in rows.columns}
        cols = [(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        by = order or [F.desc("_place")]
        placed = self._spread(rows.withColumn("_place", F.monotonically_increasing_id()), state)
        last = placed.withColumn("_row", F.row_number().over(Window.partitionBy(BUCKET, *self.keys).orderBy(*by))).where("_row = 1")
        segment = self._write(last.select(*cols, BUCKET), f"data/{SEQ}={number + 1}/{WRITER}={uuid.uuid4().hex}")
        done = {"rows": segment["rows"] if segment else 0, "replaced": 0}

        def make(next_: int, _: int, now: dict) -> dict | None:
            nonlocal segment
            if segment is None:
                return None
            segment = self._move("data", segment, SEQ, next_)
            keys = self._scan("data", [segment["name"]], StructType([self.schema[k] for k in self.keys]), SEQ).select(BUCKET, *self.keys)
            dead = self._killed(keys, next_, now)
            done["replaced"] = dead["rows"] if dead else 0
            return now | {"segments": [*now["segments"], segment | {"seq": next_}], "dead": [*now["dead"], *([dead] if dead else [])], "rows": now["rows"] + segment["rows"] - done["replaced"]}

        state = self._change(make, tries)
        if sum(s["bytes"] < self.small_bytes for s in state["segments"]) >= self.most_segments:
            self.compact()
            self.vacuum()
        return done

    def delete(self, ids: DataFrame, tries: int = 5) -> int:
        """Delete the rows of these keys; how many there were."""
        done = 0

        def make(next_: int, _: int, now: dict) -> dict | None:
            nonlocal done
            keys = [F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys]
            wanted = ids.select(*keys).withColumn(BUCKET, self._bucket(now, *[F.col(k) for k in self.keys])).distinct()
            dead = self._killed(wanted, next_, now)
            done = dead["rows"] if dead else 0
            return now | {"dead": [*now["dead"], dead], "rows": now["rows"] - done} if dead else None

        self._change(make, tries)
        return done

    def clear(self, tries: int = 5) -> None:
        self._change(lambda next_, _, now: now | {"segments": [], "dead": [], "rows": 0}, tries)

    # --- upkeep

    def compact(self, whole: bool = False, tries: int = 5) -> bool:
        """Put segments together: the small ones, or all when ``whole`` or when a third of the rows are dead.

        Changes that others make meanwhile stand, as long as they leave these segments in place."""
        _, number, state = self._state()
        dead = sum(d["rows"] for d in state["dead"])
        whole = whole or 3 * dead > state["rows"] + dead
        chosen = [s for s in state["segments"] if whole or s["bytes"] < self.small_bytes]
        if len(chosen) < 2 and not (chosen and state["dead"]):
            return False
        seq, names = max(s["seq"] for s in chosen), {s["name"] for s in chosen}
        rows = self._spread(self._live(state, chosen).drop(BUCKET), state).sortWithinPartitions(BUCKET, *self.keys)
        made = self._write(rows, f"data/{SEQ}={seq}/{WRITER}={uuid.uuid4().hex}")

        def make(_next: int, _: int, now: dict) -> dict | None:
            if not names <= {s["name"] for s in now["segments"]}:
                return None
            left = [s for s in now["segments"] if s["name"] not in names] + ([made | {"seq": seq}] if made else [])
            return now | {"segments": left, "dead": [d for d in now["dead"] if any(s["seq"] < d["upto"] for s in left)]}

        self._change(make, tries)
        return True

    def vacuum(self, keep: int = 2, orphans_after: float = 86_400.0) -> int:
        """Forget all states but the last ``keep`` and delete files that only forgotten ones name, and files that none names
        once they are ``orphans_after`` seconds old; how many parts went."""
        numbers = self.log.numbers()
        states = {n: self.log.get(n) for n in numbers}
        kept = set([n for n in numbers if states[n] is not None][-keep:])
        of = lambda ns: {f"{kind}/{x['name']}" for n in ns if states[n] for kind, entries in (("data", states[n]["segments"]), ("dead", states[n]["dead"])) for x in entries}
        named, path, gone = of(kept), self.spark._jvm.org.apache.hadoop.fs.Path, 0
        old = of(set(numbers) - kept) - named
        for kind in ("data", "dead"):
            top = path(f"{self.folder}/{kind}")
            for part in self.log.fs.globStatus(path(f"{self.folder}/{kind}/*/*")) if self.log.fs.exists(top) else []:
                name = f"{kind}/{part.getPath().getParent().getName()}/{part.getPath().getName()}"
                if name in old or name not in named and part.getModificationTime() / 1000 < time.time() - orphans_after:
                    self.log.fs.delete(part.getPath(), True)
                    gone += 1
        for n in set(numbers) - kept:
            if n < max(kept, default=0):
                self.log.forget(n)
        return gone
