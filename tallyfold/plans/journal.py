"""Job journal: an upload's effects are declared before the first one and
finished by whichever job runs next.

An upload job computes everything it will write first, stages it under the
shared scratch folder, and records an intent: the upload's key (its module and
the hashes of its files), the staged tables by path and schema, and the steps
in order. Only then does it write, step by step, marking each step done. Every
step is keyed, so that running it again leaves the same table: upserts by key,
and appends of the rows whose ids are not stored yet. A job that dies leaves
an open intent; the next upload job of the store, before anything else, rolls
every open intent forward from its staged tables, so the dead upload ends as an
undisturbed run would have, with its audit and ledger rows once.

Files: ``<store>/_journal/<key>/intent.json``, ``<step>.done`` and
``complete``, each created once; nothing is rewritten in place.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.session import new_scratch
from tallyfold.sources.warehouse import Store

# Tests set this to stop a job right after a step's write (before its mark).
FAULT: Callable[[str], None] | None = None

STEPS: dict[str, Callable[[Store, dict[str, DataFrame]], None]] = {}


def step(name: str):
    def register(fn):
        STEPS[name] = fn
        return fn

    return register


def append_absent(store: Store, name: str, rows: DataFrame, id_col: str) -> None:
    """Append the rows whose ids are not stored yet. Stored rows are read
    within the rows' id range only, which Parquet statistics narrow to few
    row groups."""
    bounds = rows.agg(F.min(id_col), F.max(id_col)).first()
    if bounds[0] is None:
        return
    stored = store.read(name).filter(F.col(id_col).between(bounds[0], bounds[1])).select(id_col)
    store.append(name, rows.join(stored, id_col, "left_anti"))


class Journal:
    def __init__(self, store: Store):
        self.store = store
        self.root = f"{store.root}/_journal"

    def _exists(self, where: str) -> bool:
        path, fs = self.store._fs(where)
        return fs.exists(path)

    def _create(self, where: str, text: str = "") -> None:
        """The file, written whole under another name and renamed, so that a
        reader never sees part of it."""
        path, fs = self.store._fs(where)
        if fs.exists(path):
            return
        part, _ = self.store._fs(f"{where}.{uuid.uuid4().hex}.part")
        stream = fs.create(part, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.rename(part, path):
            fs.delete(part, False)

    def _read(self, where: str) -> str:
        path, fs = self.store._fs(where)
        stream = fs.open(path)
        try:
            return self.store.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    @staticmethod
    def key_of(module: str, hashes: list[str]) -> str:
        return hashlib.sha256(("\n".join([module, *sorted(hashes)])).encode()).hexdigest()[:32]

    def begin(self, key: str, module: str, frames: dict[str, DataFrame], steps: list[str]) -> dict:
        """Record the intent of an upload whose staged ``frames`` the ``steps``
        write, before any of them runs."""
        where = f"{self.root}/{key}/intent.json"
        if not self._exists(where):
            kept = {}
            for n, df in frames.items():
                path = new_scratch(self.store.spark, f"journal-{n}")
                df.write.parquet(path)
                kept[n] = {"path": path, "schema": df.schema.json()}
            self._create(where, json.dumps({"key": key, "module": module, "steps": steps, "frames": kept}))
        return json.loads(self._read(where))

    def frames(self, intent: dict) -> dict[str, DataFrame]:
        spark = self.store.spark
        return {
            n: spark.read.schema(T.StructType.fromJson(json.loads(f["schema"]))).parquet(f["path"])
            for n, f in intent["frames"].items()
        }

    def run(self, intent: dict) -> None:
        """The intent's steps not marked done, in order; then complete."""
        key, frames = intent["key"], None
        for name in intent["steps"]:
            mark = f"{self.root}/{key}/{name}.done"
            if self._exists(mark):
                continue
            frames = frames or self.frames(intent)
            STEPS[name](self.store, frames)
            if FAULT is not None:
                FAULT(name)
            self._create(mark)
        self._create(f"{self.root}/{key}/complete")

    def open_intents(self) -> list[dict]:
        path, fs = self.store._fs(self.root)
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            key = status.getPath().getName()
            if self._exists(f"{self.root}/{key}/intent.json") and not self._exists(f"{self.root}/{key}/complete"):
                found.append(json.loads(self._read(f"{self.root}/{key}/intent.json")))
        return found

    def recover(self) -> int:
        """Roll every open intent forward; returns how many there were."""
        intents = self.open_intents()
        for intent in intents:
            self.run(intent)
        return len(intents)
