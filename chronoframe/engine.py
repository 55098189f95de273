"""Put and get: a store of points in a folder that the cluster shares.

``put`` appends its rows to an inbox and lets the checkpointed ingest stream take them up, so a point is admitted
once even if the job is ended on the way, and the state kept of a series is one timestamp, not its history.

Layout of the folder::

    inbox/, queue/    points to be taken up, and those of shards that are being loaded
    live/epoch=E/     admitted points of micro-batch E, by shard and bucket; a repeated batch overwrites its own
    sealed/target=T/  points of finalized buckets, by shard and bucket, sorted by key and time
    keys/gen=G/       records of the key list: what compaction G left, and what came after it
    shards.json       state, last finalized bucket, oldest kept bucket and reliable time of each shard, and the newest G

``shards.json`` is replaced by one rename after the data it speaks of is written, and readers go by it: a bucket is read
from ``sealed`` up to the last finalized one and from ``live`` after it, so a step that breaks off shows nowhere.
"""

from __future__ import annotations

import functools
import json
import operator
import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronoframe.config import DEFAULT, READABLE, EngineConfig
from chronoframe.functions.buckets import bucket
from chronoframe.operators import admit, catalog, lifecycle, read
from chronoframe.sources import files
from chronoframe.streaming import ingest

KEYS = "shard_id int, key_id int, key string, category int, seq long, live boolean"
#: The states in which points are queued.
LOADING = ("PRE_OWNED", "READING_KEYS", "READING_KEYS_DONE", "READING_LOGS", "PROCESSING_QUEUED_DATA_POINTS")
#: Keys of a request table that are pushed to the scan; of more, only shards and times are.
PUSHED_KEYS = 1000


class PutResult(NamedTuple):
    attempted: int
    #: Rows that aren't stored: without key, time, value or arrival, outside the readable shards, or of a finalized bucket.
    refused: int
    #: Rows that their series took; the rest is older than the series, or queued.
    accepted: int
    queued: int = 0


class Shard(NamedTuple):
    state: str = "OWNED"
    last_finalized: int = 0
    #: Buckets before this one are deleted.
    floor: int = 0
    reliable_from: int = 0


class Engine:
    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = DEFAULT, owned: frozenset[int] | None = None):
        """``owned`` are the shards that are owned at first; None allows all."""
        self.spark, self.path, self.config, self.open = spark, path.rstrip("/"), config, owned is None
        if owned and not self._here(f"{self.path}/shards.json"):
            self._save({s: Shard() for s in owned}, 0)

    # -- files and the shard table -------------------------------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _here(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _remove(self, pattern: str) -> None:
        fs, where = self._fs(pattern)
        for found in fs.globStatus(where) or []:
            fs.delete(found.getPath(), True)

    def _load(self) -> tuple[dict[int, Shard], int]:
        path = f"{self.path}/shards.json"
        if not self._here(path):
            return {}, 0
        fs, where = self._fs(path)
        stream = fs.open(where)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        saved = json.loads(text)
        return {int(k): Shard(*v) for k, v in saved["shards"].items()}, saved["keys"]

    def _save(self, shards: dict[int, Shard], gen: int) -> None:
        fs, tmp = self._fs(f"{self.path}/shards.json.tmp")
        stream = fs.create(tmp, True)
        stream.write(bytearray(json.dumps({"shards": {k: list(v) for k, v in shards.items()}, "keys": gen}).encode()))
        stream.close()
        _, where = self._fs(f"{self.path}/shards.json")
        fs_package = self.spark._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(getattr(fs_package, "Options$Rename"), 1)
        how[0] = getattr(fs_package, "Options$Rename").OVERWRITE
        fs_package.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, where, how)

    def shards(self) -> DataFrame:
        """(shard_id, state, last_finalized, floor, reliable_from) of the shards that anything is known of."""
        return self.spark.createDataFrame([(k, *v) for k, v in sorted(self._load()[0].items())], "shard_id int, state string, last_finalized long, floor long, reliable_from long")

    def state(self, shard: int) -> str:
        return self._load()[0].get(shard, Shard() if self.open else Shard("UNOWNED")).state

    def set_state(self, shard: int, to: str, now: int | None = None) -> None:
        """Changes a shard's state, or raises ValueError; queued points are taken up once it is readable."""
        shards, gen = self._load()
        old = shards.get(shard, Shard() if self.open else Shard("UNOWNED"))
        shards[shard] = old._replace(state=lifecycle.checked_transition(old.state, to))
        self._save(shards, gen)
        if old.state in LOADING and to in READABLE:
            self._take_queue(shard)

    def cancel_unowning(self, shard: int) -> bool:
        shards, gen = self._load()
        if shards.get(shard, Shard()).state != "PRE_UNOWNED":
            return False
        shards[shard] = shards[shard]._replace(state="OWNED")
        self._save(shards, gen)
        return True

    def reload(self, desired: set[int]) -> dict[int, str]:
        """Brings ownership to the desired shards; returns what was done: add, cancel or drop."""
        shards, gen = self._load()
        known = {**{s: Shard("UNOWNED") for s in desired}, **shards}
        rows = self.spark.createDataFrame([(k, v.state) for k, v in known.items()], "shard_id int, state string")
        plan = {r.shard_id: r.action for r in lifecycle.reload_plan(rows, self.spark.createDataFrame([(s,) for s in sorted(desired)], "shard_id int")).collect()}
        for shard, action in plan.items():
            known[shard] = known[shard]._replace(state={"add": "OWNED", "cancel": "OWNED", "drop": "PRE_UNOWNED"}[action])
        self._save(known, gen)
        for shard, action in plan.items():
            if action == "add":
                self._take_queue(shard)
        return plan

    def clean(self, now: int) -> None:
        """The regular cleaning: compacts the key list and deletes old buckets; shards about to be unowned are unowned."""
        self.compact_keys()
        self.delete_old(now)
        shards, gen = self._load()
        gone = {s: v._replace(state=lifecycle.checked_transition(v.state, "UNOWNED")) for s, v in shards.items() if v.state == "PRE_UNOWNED"}
        self._save(shards | gone, gen)

    def _case(self, shards: dict[int, Shard], field: str, default) -> Column:
        """A field of the shard table by shard_id."""
        values = [(s, getattr(v, field)) for s, v in shards.items()]
        if not values:
            return F.lit(default)
        table = F.create_map(*(F.lit(x) for pair in values for x in pair))
        return F.coalesce(F.element_at(table, F.col("shard_id")), F.lit(default))

    def _states(self, shards: dict[int, Shard]) -> Column:
        return self._case(shards, "state", "OWNED" if self.open else "UNOWNED")

    # -- writes --------------------------------------------------------------------------------------------------

    def put(self, points: DataFrame, strict: bool = False, now: int | None = None) -> PutResult:
        """Stores (shard_id, key, ts, value, arrival) rows that their series admit, in arrival order.

        A ``category`` column sets the series' category.  With ``strict``, a row of a shard that isn't owned raises
        PermissionError before anything is stored.
        """
        shards, _ = self._load()
        now = int(time.time()) if now is None else now
        for name, default in (("event_id", F.col("arrival")), ("category", F.lit(None).cast("int"))):
            if name not in points.columns:
                points = points.withColumn(name, default)
        ts = F.col("ts")
        if self.config.adjust_timestamps:
            ts = admit.adjusted(ts, now, self.config.allowed_behind, self.config.allowed_ahead)
        states = self._states(shards)
        whole = functools.reduce(operator.and_, (F.col(c).isNotNull() for c in ("shard_id", "ts", "value", "arrival", "event_id")), F.coalesce(F.col("key") != "", F.lit(False)))
        late = bucket(F.col("ts"), self.config.window) <= F.greatest(self._case(shards, "last_finalized", 0), self._case(shards, "floor", 0) - 1)
        rows = points.select("shard_id", "key", ts.alias("ts"), "value", "arrival", "event_id", "category")
        rows = rows.withColumn("_queued", whole & states.isin(*LOADING)).withColumn("_good", whole & states.isin(*READABLE) & ~F.coalesce(late, F.lit(True)))
        if strict and (bad := rows.where(whole & ~states.isin(*READABLE, *LOADING)).select("shard_id").first()):
            raise PermissionError(f"shard {bad[0]} isn't owned")
        seen = Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_good") & ~F.col("_queued")).alias("bad"), F.count_if("_queued").alias("queued"))
        rows.where("_good OR _queued").select("_queued", *[F.col(f.name).cast(f.dataType) for f in self._schema()], F.col("category").cast("int")).write.mode("overwrite").parquet(f"{self.path}/arriving")
        arriving = self.spark.read.parquet(f"{self.path}/arriving")
        n, bad, queued = seen.get["n"], seen.get["bad"], seen.get["queued"]
        good = arriving.where("NOT _queued")
        if queued:
            arriving.where("_queued").drop("_queued").write.mode("append").parquet(f"{self.path}/queue")
            waiting = {r[0] for r in arriving.where("_queued").select("shard_id").distinct().collect()}  # a row for each shard
            shards, gen = self._load()
            self._save(shards | {s: shards[s]._replace(reliable_from=now) for s in waiting}, gen)
        self._record(good)
        good.drop("_queued", "category").write.mode("append").parquet(f"{self.path}/inbox")
        accepted = self._drain()
        self._remove(f"{self.path}/arriving")
        return PutResult(n, bad, accepted, queued)

    def put_by_id(self, points: DataFrame) -> PutResult:
        """As ``put``, for (shard_id, key_id, ts, value, arrival) rows; rows of unknown ids are refused."""
        named = points.join(self.keys().select("shard_id", "key_id", "key"), ["shard_id", "key_id"], "left").drop("key_id")
        return self.put(named)

    def _take_queue(self, shard: int) -> None:
        if not self._here(f"{self.path}/queue"):
            return
        queue = self.spark.read.parquet(f"{self.path}/queue")
        mine, rest = queue.where(F.col("shard_id") == shard), queue.where(F.col("shard_id") != shard)
        rest.write.mode("overwrite").parquet(f"{self.path}/queue.rest")
        self._record(mine)
        mine.drop("category").write.mode("append").parquet(f"{self.path}/inbox")
        self._drain()
        self._remove(f"{self.path}/queue")
        fs, where = self._fs(f"{self.path}/queue.rest")
        fs.rename(where, self._fs(f"{self.path}/queue")[1])

    def _schema(self):
        return self.spark.createDataFrame([], ingest.ADMITTED).schema

    def _drain(self) -> int:
        """Takes the inbox up; returns how many points were admitted."""
        stream = self.spark.readStream.schema(self._schema()).parquet(f"{self.path}/inbox")
        query, admitted = ingest.into_epochs(stream, f"{self.path}/live", f"{self.path}/checkpoint", self.config.window, self.config.min_delta)
        query.awaitTermination()
        return sum(admitted)

    # -- the key list --------------------------------------------------------------------------------------------

    def _records(self) -> DataFrame:
        gen = self._load()[1]
        if not self._here(f"{self.path}/keys/gen={gen}"):
            return self.spark.createDataFrame([], KEYS)
        return self.spark.read.schema(KEYS).parquet(f"{self.path}/keys/gen={gen}")

    def keys(self) -> DataFrame:
        """(shard_id, key_id, key, category) of the live series: the last record of each id."""
        last = self._records().groupBy("shard_id", "key_id").agg(F.max_by(F.struct("key", "category", "live"), "seq").alias("r"))
        return last.where("r.live").select("shard_id", "key_id", "r.key", "r.category")

    def _append(self, records: DataFrame) -> None:
        gen = self._load()[1]
        seq = int(time.time_ns())
        records.select("shard_id", "key_id", "key", "category", F.lit(seq).alias("seq"), "live").write.mode("append").parquet(f"{self.path}/keys/gen={gen}")

    def _record(self, puts: DataFrame) -> None:
        """Records new series, each with the smallest free id of its shard, and categories that change."""
        known = self.keys()
        last = F.max_by("category", F.when(F.col("category").isNotNull(), F.struct("arrival", "event_id")))
        came = puts.groupBy("shard_id", "key").agg(last.alias("_c"), F.min("arrival").alias("arrival"))
        new = came.join(known, ["shard_id", "key"], "left_anti")
        ids = catalog.assigned(known.select("shard_id", "key_id"), new).join(new.select("shard_id", "key", "_c"), ["shard_id", "key"])
        changed = known.join(came, ["shard_id", "key"]).where("_c IS NOT NULL AND _c <> category").drop("category", "arrival")
        both = ids.unionByName(changed.select(*ids.columns)).withColumn("category", F.coalesce("_c", F.lit(0))).withColumn("live", F.lit(True))
        self._append(both)

    def erase(self, series: DataFrame) -> None:
        """Takes (shard_id, key) series out of the key list; their ids are free again."""
        self._append(self.keys().join(series.select("shard_id", "key").distinct(), ["shard_id", "key"]).withColumn("live", F.lit(False)))

    def compact_keys(self) -> None:
        """Rewrites the key list as its live records, in a new generation."""
        shards, gen = self._load()
        self.keys().withColumn("seq", F.lit(0).cast("long")).withColumn("live", F.lit(True)).select("shard_id", "key_id", "key", "category", "seq", "live").write.mode("overwrite").parquet(f"{self.path}/keys/gen={gen + 1}")
        self._save(shards, gen + 1)
        self._remove(f"{self.path}/keys/gen={gen}")

    # -- finalization and retention ------------------------------------------------------------------------------

    def finalize(self, now: int) -> int:
        """Seals the buckets that are closed at ``now``; returns up to which."""
        target = lifecycle.last_closed(now, self.config.window, self.config.allowed_behind, self.config.finalize_slack)
        return self.finalize_to(target)

    def finalize_to(self, target: int) -> int:
        """Seals every bucket up to the target of all owned shards; later puts into them are refused."""
        shards, gen = self._load()
        seen = {} if not self.open else {r[0]: Shard() for r in self._live().select("shard_id").distinct().collect()}  # a row for each shard
        due = {s: v for s, v in (seen | shards).items() if v.state == "OWNED" and v.last_finalized < target}
        if not due:
            return target
        rows = self._live().where(F.col("shard_id").isin(*due) & (F.col("bucket") <= target) & (F.col("bucket") > self._case(due, "last_finalized", 0)))
        laid = rows.repartition("shard_id", "bucket").sortWithinPartitions("shard_id", "bucket", "key", "ts", "arrival")
        laid.write.mode("overwrite").partitionBy("shard_id", "bucket").parquet(f"{self.path}/sealed/target={target}")
        self._save(shards | {s: v._replace(last_finalized=target) for s, v in due.items()}, gen)
        for s in due:
            self._remove_buckets(f"{self.path}/live/epoch=*/shard_id={s}", lambda b: b <= target)
        return target

    def delete_old(self, now: int) -> None:
        """Deletes the buckets that retention no longer keeps."""
        shards, gen = self._load()
        floor = lifecycle.oldest_kept(now, self.config.window, self.config.keep_buckets)
        seen = {} if not self.open else {r[0]: Shard() for r in self.points().select("shard_id").distinct().collect()}  # a row for each shard
        self._save({s: v._replace(floor=max(v.floor, floor)) if v.state == "OWNED" else v for s, v in (seen | shards).items()}, gen)
        for s, v in (seen | shards).items():
            if v.state == "OWNED":
                for kind in ("live/epoch=*", "sealed/target=*"):
                    self._remove_buckets(f"{self.path}/{kind}/shard_id={s}", lambda b: b < floor)

    def _remove_buckets(self, pattern: str, gone) -> None:
        fs, where = self._fs(f"{pattern}/bucket=*")
        for found in fs.globStatus(where) or []:
            if gone(int(found.getPath().getName().removeprefix("bucket="))):
                fs.delete(found.getPath(), True)

    # -- reads ---------------------------------------------------------------------------------------------------

    def _part(self, name: str) -> DataFrame:
        fs, where = self._fs(f"{self.path}/{name}/*/shard_id=*/bucket=*")
        if not (fs.exists(self._fs(f"{self.path}/{name}")[1]) and fs.globStatus(where)):
            return self.spark.createDataFrame([], f"{ingest.ADMITTED}, bucket long")
        found = self.spark.read.schema(f"{ingest.ADMITTED}, bucket long").parquet(f"{self.path}/{name}")
        return found.select(*[f.name for f in self._schema()], "bucket")

    def _live(self) -> DataFrame:
        return self._part("live")

    def points(self) -> DataFrame:
        """All stored points of readable shards, laid out by shard and bucket."""
        shards, _ = self._load()
        last, floor = self._case(shards, "last_finalized", 0), self._case(shards, "floor", 0)
        sealed, live = self._part("sealed"), self._live()
        if shards:
            # constants, so that folders are pruned before the exact conditions
            sealed = sealed.where(F.col("bucket") <= max(v.last_finalized for v in shards.values()))
            live = live if self.open else live.where(F.col("bucket") > min(v.last_finalized for v in shards.values()))
        out = sealed.where(F.col("bucket") <= last).unionByName(live.where(F.col("bucket") > last)).where(F.col("bucket") >= floor)
        if not self.open:
            out = out.where(F.col("shard_id").isin(*[s for s, v in shards.items() if v.state in READABLE]))
        elif closed := [s for s, v in shards.items() if v.state not in READABLE]:
            out = out.where(~F.col("shard_id").isin(*closed))
        return out

    def sealed_buckets(self) -> DataFrame:
        """(shard_id, bucket) of the sealed buckets, newest first, as they are to be loaded."""
        return self._part("sealed").select("shard_id", "bucket").distinct().orderBy(F.desc("bucket"), "shard_id")

    def get(self, requests: DataFrame, strict: bool = False) -> DataFrame:
        """Points of (req_idx, shard_id, key, begin, end) rows, in request order, and whether data is whole from ``begin`` on.

        The shards, times and, where they are few, keys that all requests span are pushed to the scan; a series' reads end
        ``keep_buckets`` before its newest bucket.  ``strict`` raises KeyError for an unknown series and PermissionError
        for a shard that isn't owned or still being loaded.
        """
        shards, _ = self._load()
        if strict:
            bad = requests.where(~self._states(shards).isin(*READABLE)).orderBy("req_idx").select("shard_id", self._states(shards).alias("s")).first()
            if bad:
                raise PermissionError(f"shard {bad[0]} is {'being loaded' if bad[1] in LOADING else 'not owned'}")
            if unknown := read.missing(self.keys(), requests).orderBy("req_idx").first():
                raise KeyError(unknown["key"])
        points = read.spanned(self.points(), requests, self.config.window, PUSHED_KEYS, self.config.keep_buckets)
        out = read.get(points, requests)
        begins = requests.select("req_idx", (F.col("begin") >= self._case(shards, "reliable_from", 0)).alias("reliable"))
        return out.join(begins, "req_idx").orderBy("req_idx", "ts", "arrival")

    def view(self, name: str = "points") -> None:
        """Makes the points a view for SQL."""
        self.points().createOrReplaceTempView(name)

    # -- recovery ------------------------------------------------------------------------------------------------

    def recover(self, folder: str, now: int) -> DataFrame:
        """Takes in binary key lists, block files and logs; returns records of unknown keys by shard.

        Blocks of completed files become sealed buckets.  Logs that the last block doesn't cover are replayed through ``put``.
        """
        live = catalog.dedup_records(files.read_keys(self.spark, folder), self.config.max_key_bytes, self.config.max_key_id)
        live = live.withColumn("key", F.col("key").cast("string")).select("shard_id", "key_id", "key", "category").withColumn("live", F.lit(True))
        self._append(live)
        keys = self.keys()
        blocks = files.keyed(files.points_of(files.read_blocks(self.spark, folder), self.config.default_delta), keys)
        blocks = blocks.select("shard_id", "key", "ts", "value", F.col("ts").alias("arrival"), F.lit(0).cast("long").alias("event_id"), "bucket")
        done = files.completed(self.spark, folder)
        last = {r[0]: r[1] for r in done.groupBy("shard_id").agg(F.max("file_id")).collect()}  # a row for each shard
        shards, gen = self._load()
        if last:
            target = max(last.values())
            blocks.repartition("shard_id", "bucket").sortWithinPartitions("shard_id", "bucket", "key", "ts").write.mode("overwrite").partitionBy("shard_id", "bucket").parquet(f"{self.path}/sealed/target={target}")
        log = files.read_logs(self.spark, folder).withColumnRenamed("seq", "event_id").withColumn("arrival", F.col("file_ts")).join(keys.select("shard_id", "key_id", "key"), ["shard_id", "key_id"], "left")
        log = log.withColumn("_last", self._case({s: Shard(last_finalized=b) for s, b in last.items()}, "last_finalized", 0))
        log = log.where((F.col("_last") == 0) | (F.col("file_ts") >= (F.col("_last") - 1) * self.config.window)).drop("_last")
        replay = lifecycle.replayed(log, keys, self.config.window, 0)
        gaps = functools.reduce(DataFrame.unionByName, [lifecycle.log_gaps(replay.where(F.col("shard_id") == s), self.config.log_gap, start=(b - 1) * self.config.window, now=now) for s, b in last.items()], self.spark.createDataFrame([], "shard_id int, event_id long, ts long, newest_before long"))
        holes = lifecycle.missing_files(done.select("shard_id", F.col("file_id").alias("id")))
        reliable = {r[0]: r[1] for r in lifecycle.reliable_from(gaps, holes, now).collect()}  # a row for each shard
        base = {s: shards.get(s, Shard()) for s in {*shards, *last, *reliable}}
        self._save({s: v._replace(last_finalized=max(v.last_finalized, last.get(s, 0)), reliable_from=max(v.reliable_from, reliable.get(s, 0))) for s, v in base.items()}, gen)
        # what a block holds is refused here, as its bucket is sealed
        self.put(replay.where("known").select("shard_id", "key", "ts", "value", "arrival", "event_id"))
        return lifecycle.unknown_keys(replay)
