"""Settings and their checks, safe paths, and what the environment offers."""

from __future__ import annotations

import ipaddress
import os
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass
from importlib.util import find_spec
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from quillspark.errors import AirGapViolation, ConfigurationError, PathRefused
from quillspark.operators.embedding import BACKENDS
from quillspark.operators.search import RERANKERS

# Folders that are never read.
DENIED = ("/etc", "/proc", "/sys", "/dev", "/var/run", "~/.ssh", "~/.gnupg")
#: Passwords that nobody may keep.
WEAK = ("password", "changeme", "postgres", "secret", "admin")


def safe_path(path: str, roots: Sequence[str] = (), allow_temp: bool = True) -> str:
    """The resolved path, if it lies below one of ``roots`` (the working folder if there are none) or the temporary folder, in no denied folder, and
    no part of it is a link; else PathRefused."""
    given = Path(os.path.expanduser(path))
    if given.is_symlink():
        raise PathRefused(f"{path} is a link")
    real = given.resolve()
    if any(real.is_relative_to(Path(os.path.expanduser(d)).resolve()) for d in DENIED):
        raise PathRefused(f"{path} is in a system folder")
    allowed = [Path(r).resolve() for r in (roots or [os.getcwd()])]
    allowed += [Path(tempfile.gettempdir()).resolve(), Path("/tmp").resolve()] if allow_temp else []  # noqa: S108
    if not any(real.is_relative_to(r) for r in allowed):
        raise PathRefused(f"{path} is outside the folders that may be read")
    return str(real)


def _is_local(url: str) -> bool:
    host = urlsplit(url if "//" in url else f"//{url}").hostname or ""
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return host in ("", "localhost") or host.endswith((".local", ".internal", ".lan")) or "." not in host
    return address.is_loopback or address.is_private


@dataclass(frozen=True)
class Settings:
    """What a deployment chooses. `checked` refuses what would leave the network or is open to anyone."""

    embed_backend: str = "deterministic"
    embed_url: str = ""
    reranker: str | None = None
    dimension: int = 1024
    database_url: str = ""
    allow_cloud: bool = False

    def checked(self) -> Settings:
        if self.embed_backend not in BACKENDS:
            raise ConfigurationError(f"no embedding backend {self.embed_backend}")
        if self.reranker is not None and self.reranker not in RERANKERS:
            raise ConfigurationError(f"no reranker {self.reranker}")
        if self.dimension < 1:
            raise ConfigurationError("a vector has at least one dimension")
        if not self.allow_cloud and not _is_local(self.embed_url):
            raise AirGapViolation(f"{self.embed_url} is not in the local network")
        password = urlsplit(self.database_url).password or ""
        if password.lower() in WEAK:
            raise ConfigurationError("the database has a password that everybody knows")
        return self


def diagnostics(spark: SparkSession, settings: Settings | None = None) -> DataFrame:
    """One row on the environment: versions, settings that matter, backends, optional libraries, and whether the settings hold."""
    try:
        (settings or Settings()).checked()
        problem = None
    except ConfigurationError as e:
        problem = str(e)
    conf = lambda k: spark.conf.get(k, None)
    offered = [m for m in ("pyarrow", "pandas", "numpy", "onnxruntime", "tokenizers", "zstandard") if find_spec(m)]
    row = (spark.version, spark.sparkContext.defaultParallelism, conf("spark.sql.shuffle.partitions"), conf("spark.sql.adaptive.enabled"), conf("spark.checkpoint.dir"), sorted(BACKENDS), sorted(RERANKERS), offered, problem)
    return spark.createDataFrame([row], "spark_version string, parallelism int, shuffle_partitions string, adaptive string, shared_folder string, embedding_backends array<string>, rerankers array<string>, libraries array<string>, problem string")
