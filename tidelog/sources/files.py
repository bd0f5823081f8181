"""Files of a store, through the file systems Spark knows. Driver side, small files only."""

from __future__ import annotations

import json
import os
import re
import socket
import threading
import time
import uuid

from pyspark.sql import SparkSession

from tidelog.schema import IOFailure

RUN, MANIFEST, LOCK, DRAFT = "run-%08d", "%012d.json", "LOCK", ".tmp"
_NAME = re.compile(r"(?:run-(\d{8})|(\d{12})\.json)\Z")


def parse_name(name: str) -> tuple[str, int] | None:
    """``("run", id)`` or ``("manifest", version)``; None for any other name."""
    found = _NAME.match(name)
    if not found:
        return None
    return ("run", int(found[1])) if found[1] else ("manifest", int(found[2]))


class Files:
    """The few operations a store needs on a root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark = spark
        self._jvm = spark.sparkContext._jvm
        self._hadoop_path = self._jvm.org.apache.hadoop.fs.Path  # looking it up is a call for each part of the name
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop_path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def make_folder(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def create(self, name: str, data: bytes, step=lambda name: None) -> bool:
        """Write a new file under its final name; False if that exists. It appears whole or not at all.

        A draft gets the final name by a hard link on local disks and by a rename that replaces nothing
        on HDFS, so a crash leaves at most the draft. Other file systems, object stores, show a file when
        it is closed, and are asked not to replace one.
        """
        if self.exists(name):
            return False
        scheme = self._fs.getScheme()
        if scheme not in ("file", "hdfs", "viewfs", "webhdfs", "swebhdfs"):
            return self._written(name, data)
        draft = f"{name}.{uuid.uuid4().hex}{DRAFT}"
        self._written(draft, data)
        step("draft written")
        try:
            if scheme == "file":
                local = lambda n: self._jvm.java.io.File(self._path(n).toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(name), local(draft))
            else:
                return bool(self._fs.rename(self._path(draft), self._path(name)))  # HDFS replaces no file
        except Exception as taken:
            if self.exists(name):
                return False
            raise IOFailure(str(taken)) from taken
        finally:
            self.delete(draft)
        return True

    def _written(self, name: str, data: bytes) -> bool:
        """Write a file that must not exist yet; False if it does."""
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as taken:
            if self.exists(name):
                return False
            raise IOFailure(str(taken)) from taken
        try:
            out.write(data)
            getattr(out, "hsync", lambda: None)()
        finally:
            out.close()
        return True

    def touch(self, name: str) -> None:
        """Make the file one of now; a file system without such times gets it written anew."""
        now = int(time.time() * 1000)
        try:
            self._fs.setTimes(self._path(name), now, -1)
        except Exception:
            data = self.read(name)
            out = self._fs.create(self._path(name), True)
            out.write(data)
            out.close()

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise IOFailure(f"{old} could not be renamed to {new}")

    def age(self, name: str) -> float:
        """Seconds since a file was written."""
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Lock:
    """The writer's lock of a store: a file that names its owner and is renewed while the owner lives.

    A lock is void if its process is known to be gone, or if nobody has renewed it for ``lease`` seconds.
    It keeps writers apart that behave; what makes a late one harmless is that every opening writer
    commits first, so that any commit prepared before fails.
    """

    def __init__(self, files: Files, lease: float) -> None:
        self.files, self.lease, self.token = files, lease, uuid.uuid4().hex
        self._stop = threading.Event()

    def take(self) -> bool:
        """Create the lock, or take over a void one; False if it is held."""
        if not self._create():
            if not self._void():
                return False
            gone = f"{LOCK}.{self.token}{DRAFT}"
            try:
                self.files.rename(LOCK, gone)
            except Exception:  # someone else was faster
                return False
            self.files.delete(gone)
            if not self._create():
                return False
        threading.Thread(target=self._renew, daemon=True, name="store-lock").start()
        return True

    def _create(self) -> bool:
        owner = {"token": self.token, "host": socket.gethostname(), "pid": os.getpid()}
        return self.files.create(LOCK, json.dumps(owner).encode())

    def _owner(self) -> dict:
        try:
            return json.loads(self.files.read(LOCK))
        except Exception:  # gone, or just being renewed
            return {}

    def _void(self) -> bool:
        owner = self._owner()
        if owner.get("host") == socket.gethostname():
            try:
                os.kill(owner["pid"], 0)
            except ProcessLookupError:
                return True
            except PermissionError:
                pass
        try:
            return self.files.age(LOCK) > self.lease
        except Exception:
            return False

    def _renew(self) -> None:
        while not self._stop.wait(self.lease / 4):
            try:
                if self._owner().get("token") != self.token:
                    return
                self.files.touch(LOCK)
            except Exception:
                return

    def stop(self) -> None:
        self._stop.set()

    def release(self) -> None:
        self.stop()
        if self._owner().get("token") == self.token:
            self.files.delete(LOCK)
