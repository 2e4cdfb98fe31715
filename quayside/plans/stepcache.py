"""Steps that keep their result as Parquet and run again only when something they depend on has changed."""

from __future__ import annotations

import hashlib
import inspect
import json
import logging
import os
import time
from collections.abc import Callable, Iterable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)
FORMAT = 1


class StepCache:
    """Steps below one root folder, in any store that Spark reads.

    A step's fingerprint covers its inputs' file sizes and times, the source of its
    code and its version.  FORCE_STEPS=1 in the environment reruns everything.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files, by Hadoop's interface
    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.resolve(path))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def resolve(self, path: str) -> str:
        return path if path.startswith("/") or "://" in path else f"{self.root}/{path}"

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def _signature(self, path: str) -> list[str]:
        """size:time of each file below a path, or that it is missing."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return [f"{path}=missing"]
        files, found = fs.listFiles(where, True), []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}={f.getLen()}:{f.getModificationTime()}")
        return sorted(found)

    def _manifest(self) -> dict:
        fs, where = self._at("manifest.json")
        if not fs.exists(where):
            return {}
        stream = fs.open(where)
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            data = json.loads(raw)
        except ValueError:
            return {}
        return data["steps"] if data.get("format") == FORMAT else {}

    def _record(self, name: str, entry: dict) -> None:
        """The manifest is written beside and then put in place, so a reader never sees half of it."""
        steps = self._manifest() | {name: entry}
        fs, new = self._at("manifest.json.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"format": FORMAT, "steps": steps}, sort_keys=True, indent=1).encode()))
        out.close()
        _, old = self._at("manifest.json")
        fs.delete(old, False)
        fs.rename(new, old)

    def fingerprint(self, inputs: Iterable[str], code: Iterable[object], version: int) -> str:
        digest = hashlib.sha256(f"{FORMAT}/{version}".encode())
        for line in sorted(x for p in inputs for x in self._signature(p)):
            digest.update(line.encode())
        for source in sorted(inspect.getsource(c) for c in code):
            digest.update(hashlib.sha256(source.encode()).digest())
        return digest.hexdigest()

    def summary(self) -> list[tuple[str, str, float]]:
        """(step, fingerprint, seconds) of what the manifest holds."""
        return [(k, v["fingerprint"], v["seconds"]) for k, v in sorted(self._manifest().items())]

    def step(self, name: str, inputs: Iterable[str] = (), outputs: Iterable[str] = (), code: Iterable[object] = (), version: int = 1) -> Callable:
        """Decorates a function that returns a DataFrame for one output, or a dict of them by output for several."""
        inputs, outputs = list(inputs), list(outputs)

        def decorate(f: Callable) -> Callable:
            @wraps(f)
            def run(*args, force: bool = False, **kwargs):
                mark = self.fingerprint(inputs, [*code, f], version)
                known = self._manifest().get(name, {}).get("fingerprint") == mark
                if known and not force and os.environ.get("FORCE_STEPS") != "1" and all(map(self.exists, outputs)):
                    log.info("step %s is as it was (%s)", name, mark[:8])
                    return self._read(outputs)
                began = time.time()
                made = f(*args, **kwargs)
                parts = {outputs[0]: made} if len(outputs) == 1 and isinstance(made, DataFrame) else made
                if not isinstance(parts, dict) or set(parts) != set(outputs) or not all(isinstance(x, DataFrame) for x in parts.values()):
                    raise TypeError(f"step {name} must return a DataFrame for each of {outputs}")
                for path, df in parts.items():
                    df.write.mode("overwrite").parquet(self.resolve(path))
                self._record(name, {"fingerprint": mark, "seconds": round(time.time() - began, 3), "outputs": outputs})
                log.info("step %s ran in %.1f s", name, time.time() - began)
                return self._read(outputs)

            return run

        return decorate

    def _read(self, outputs: list[str]):
        read = {p: self.spark.read.parquet(self.resolve(p)) for p in outputs}
        return read[outputs[0]] if len(outputs) == 1 else read
