"""A ledger that streams and batch jobs append to while readers read and a compaction runs.

Layout: ``parts/<writer>/<number>`` holds what one run of a writer appended, for good once its
``_SUCCESS`` is there.  A generation is a folder ``bases/<generation>`` with retained entries and a
manifest that says which parts they came from.  Readers take the newest manifest's base and every
complete part that it does not cover, so

* a run that is repeated (same writer and number) finds its part complete and adds nothing,
* a part that is added while a compaction runs is not in its manifest and stays visible,
* a manifest appears whole or not at all, and of two compactions of one generation one gives way,
* files that an earlier reader uses stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from context_shaper import fixed_values as V
from context_shaper.operators.ordering import newest_rows
from context_shaper.sources import folders
from context_shaper.sources.documents import is_json
from context_shaper.sources.ledger import LEDGER_SCHEMA

_PLACE = "writer string, part bigint, line bigint"
_ENTRY = f"{LEDGER_SCHEMA}, {_PLACE}"
COLUMNS = [field.split(" ")[0] for field in _ENTRY.split(", ")]


@dataclass(frozen=True)
class Merged:
    """Parts of a writer that a generation holds: all up to a number, and some beyond."""

    upto: int = -1
    beyond: tuple[int, ...] = ()

    def holds(self, number: int) -> bool:
        return number <= self.upto or number in self.beyond

    def plus(self, numbers: list[int]) -> Merged:
        rest, upto = sorted({*self.beyond, *numbers}), self.upto
        while rest and rest[0] <= upto + 1:
            upto = max(upto, rest.pop(0))
        return Merged(upto, tuple(rest))


@dataclass(frozen=True)
class Snapshot:
    """What a reader sees: a generation (0 before the first compaction), its base, and the parts since."""

    generation: int
    base: str | None
    merged: dict[str, Merged]
    parts: tuple[tuple[str, int], ...]


class LedgerStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # --- appending ---------------------------------------------------------------------------

    def append(self, entries: DataFrame, writer: str, number: int) -> bool:
        """Add a run's entries; False if this run of this writer has been added before.

        Entries of equal time are ordered by their ``seq`` if they have it.  A run that broke off before ``_SUCCESS`` leaves a folder that nobody reads; it is written anew.
        """
        path = self._part(writer, number)
        held = self._manifest()[2].get(writer, Merged())
        if held.holds(number) or folders.exists(self.spark, f"{path}/_SUCCESS"):
            return False
        fields = [name for name in entries.columns if name != "seq"]
        line = F.col("seq") if "seq" in entries.columns else F.monotonically_increasing_id()
        placed = entries.select(
            *fields, F.lit(writer).alias("writer"), F.lit(number).cast("bigint").alias("part"), line.alias("line")
        )
        self._write(placed, path)
        return True

    def _part(self, writer: str, number: int) -> str:
        return f"{self.root}/parts/{writer}/{number:012d}"

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").option(
            "mapreduce.fileoutputcommitter.marksuccessfuljobs", "true"
        ).text(path)

    # --- reading -----------------------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        """The newest generation, and the complete parts that are not in it.

        Parts are listed before the manifest is read: a part that a compaction merges in between
        is then in the manifest, never lost.
        """
        listed = [
            (writer, int(number))
            for writer in folders.subfolders(self.spark, f"{self.root}/parts")
            for number in folders.subfolders(self.spark, f"{self.root}/parts/{writer}")
            if folders.exists(self.spark, f"{self.root}/parts/{writer}/{number}/_SUCCESS")
        ]
        generation, base, merged = self._manifest()
        return Snapshot(generation, base, merged, tuple(x for x in listed if not merged.get(x[0], Merged()).holds(x[1])))

    def _manifest(self) -> tuple[int, str | None, dict[str, Merged]]:
        names = [name for name in folders.files(self.spark, f"{self.root}/manifests") if name.endswith(".json")]
        if not names:
            return 0, None, {}
        found = json.loads(folders.read_text(self.spark, f"{self.root}/manifests/{names[-1]}"))
        merged = {writer: Merged(upto, tuple(beyond)) for writer, (upto, beyond) in found["merged"].items()}
        return int(names[-1].split(".")[0]), found["base"], merged

    def _folders(self, snapshot: Snapshot) -> list[str]:
        base = [f"{self.root}/bases/{snapshot.base}"] if snapshot.base else []
        return base + [self._part(*part) for part in snapshot.parts]

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Entries with their place (writer, part, line); bad lines are dropped, no event means ``check``."""
        paths = self._folders(snapshot or self.snapshot())
        if not paths:
            return self.spark.createDataFrame([], _ENTRY)
        lines = self.spark.read.text(paths)
        kind = f"struct<{_ENTRY.replace(', ', ',').replace(' ', ':')}>"
        rows = lines.filter(is_json(F.col("value"))).select(F.from_json("value", kind).alias("e")).select("e.*")
        return rows.withColumn("ev", F.coalesce("ev", F.lit("check")))

    def size(self, snapshot: Snapshot | None = None) -> int:
        return sum(folders.size(self.spark, path) for path in self._folders(snapshot or self.snapshot()))

    # --- compaction --------------------------------------------------------------------------

    def compact(
        self, max_bytes: int = V.LEDGER_MAX_BYTES, keep: int = V.LEDGER_KEEP_ENTRIES, owner: str | None = None
    ) -> int | None:
        """Start a new generation of the newest entries if the ledger outgrew ``max_bytes``.

        Returns its number, or None if nothing was to do or another compaction was first.
        """
        seen = self.snapshot()
        if self.size(seen) <= max_bytes:
            return None
        order = [F.desc("ts"), F.desc("writer"), F.desc("part"), F.desc("line")]
        generation = seen.generation + 1
        base = f"{generation:012d}-{uuid.uuid4().hex}"  # a rival of the same generation writes elsewhere
        self._write(newest_rows(self.read(seen), order, keep, owner), f"{self.root}/bases/{base}")
        added = {writer: [n for w, n in seen.parts if w == writer] for writer, _ in seen.parts}
        merged = {w: seen.merged.get(w, Merged()).plus(added.get(w, [])) for w in {*seen.merged, *added}}
        text = json.dumps({"base": base, "merged": {w: [m.upto, m.beyond] for w, m in sorted(merged.items())}})
        created = folders.create_text(self.spark, f"{self.root}/manifests/{generation:012d}.json", text)
        return generation if created else None

    def vacuum(self) -> None:
        """Delete bases and parts that the newest generation has replaced; no older reader may be running."""
        _, base, merged = self._manifest()
        for name in folders.subfolders(self.spark, f"{self.root}/bases"):
            if base and name <= base and name != base:
                folders.remove(self.spark, f"{self.root}/bases/{name}")
        for writer, held in merged.items():
            for number in folders.subfolders(self.spark, f"{self.root}/parts/{writer}"):
                if held.holds(int(number)):
                    folders.remove(self.spark, f"{self.root}/parts/{writer}/{number}")
