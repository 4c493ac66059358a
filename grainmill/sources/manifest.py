"""Manifests of runs: whole versions, published one after the other, and the latest.

A version is a JSON file, written aside and then given its number by a step that fails
if that number is taken: of several writers that publish version n + 1, one wins, and
the others learn that they lost. Readers see a version whole or not at all. A pointer
file names a version that was the latest once; readers go on from there, so it may be
stale but never wrong.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

FORMAT = 1


class Conflict(Exception):
    """Another writer has published this version."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))


def _write(fs, target, content: dict) -> None:
    out = fs.create(target, True)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()


def _read(jvm, fs, target) -> dict:
    stream = fs.open(target)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _name(version: int) -> str:
    return f"{version:09d}.json"


def publish(spark: SparkSession, path: str, content: dict, after: int | None = None) -> int:
    """Publish content as the version after `after` (0: the first; None: the latest) and
    return its number. Raises Conflict if that version is there already."""
    jvm, fs, at = _hadoop(spark, path)
    after = latest_version(spark, path) if after is None else after
    version, aside = after + 1, at(f".{uuid.uuid4().hex}.part")
    fs.mkdirs(at())
    if after and not fs.exists(at(_name(after))):
        raise ValueError(f"there is no version {after}")
    _write(fs, aside, {"format": FORMAT, "version": version, "content": content})
    target = at(_name(version))
    try:
        if fs.getScheme() == "file":  # a rename would replace
            os.link(aside.toUri().getPath(), target.toUri().getPath())
            fs.delete(aside, False)
        else:
            none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, options)
    except Exception as why:
        fs.delete(aside, False)
        if fs.exists(target):
            raise Conflict(f"version {version} of {path}") from why
        raise
    pointer = at(f".{uuid.uuid4().hex}.part")
    _write(fs, pointer, {"version": version})
    fs.delete(at("latest"), False)
    fs.rename(pointer, at("latest"))
    return version


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the latest version, 0 without any."""
    jvm, fs, at = _hadoop(spark, path)
    version = 0
    try:
        version = _read(jvm, fs, at("latest"))["version"]
    except Exception:  # there is none, or it is being replaced
        if not fs.exists(at()):
            return 0
        found = [str(x.getPath().getName()) for x in fs.listStatus(at())]
        version = max((int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit()), default=0)
    while fs.exists(at(_name(version + 1))):
        version += 1
    return version


def resolve(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The content of a version, or of the latest. A manifest of another format is an
    error, and so is none."""
    jvm, fs, at = _hadoop(spark, path)
    version = latest_version(spark, path) if version is None else version
    if not version or not fs.exists(at(_name(version))):
        raise FileNotFoundError(f"no version {version} of {path}")
    held = _read(jvm, fs, at(_name(version)))
    if held["format"] != FORMAT or held["version"] != version:
        raise ValueError(f"{path}: a manifest of format {held['format']}")
    return held["content"]
