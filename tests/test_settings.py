import os

import pytest

from quillspark.errors import AirGapViolation, ConfigurationError, DimensionMismatch, PathRefused, QuillError
from quillspark.operators.embedding import check_dimension, register_backend
from quillspark.settings import Settings, diagnostics, safe_path


def test_paths(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    root = str(tmp_path)
    assert safe_path(f"{root}/a.txt", [root], allow_temp=False) == os.path.realpath(f"{root}/a.txt")
    for bad in ("/etc/passwd", f"{root}/../../etc/hosts", "~/.ssh/id", "/usr/bin/env", "/proc/self/environ"):
        with pytest.raises(PathRefused):
            safe_path(bad, [root], allow_temp=False)
    (tmp_path / "link").symlink_to(tmp_path / "a.txt")
    with pytest.raises(PathRefused):
        safe_path(f"{root}/link", [root])
    with pytest.raises(PathRefused):
        safe_path(root + "-other/x", [root], allow_temp=False)


@pytest.mark.parametrize("bad", [{"embed_backend": "none"}, {"reranker": "none"}, {"dimension": 0}, {"database_url": "postgresql://me:changeme@localhost/db"}])
def test_settings_that_do_not_hold(bad):
    with pytest.raises(ConfigurationError):
        Settings(**bad).checked()


def test_nothing_leaves_the_network():
    for url in ("", "http://localhost:11434", "http://10.0.0.4/embed", "http://embedder:80", "http://127.0.0.1"):
        assert Settings(embed_url=url).checked()
    for url in ("https://api.example.com/v1", "http://8.8.8.8"):
        with pytest.raises(AirGapViolation):
            Settings(embed_url=url).checked()
        assert Settings(embed_url=url, allow_cloud=True).checked()


def test_diagnostics(spark):
    row = diagnostics(spark, Settings(embed_backend="gone")).first()
    assert row["spark_version"] == spark.version and "gone" in row["problem"] and "deterministic" in row["embedding_backends"]
    assert diagnostics(spark).first()["problem"] is None


def test_backends_and_dimensions():
    register_backend("flat", lambda texts, dim: [[0.0] * dim for _ in texts])
    assert Settings(embed_backend="flat").checked()
    check_dimension(3, 3)
    with pytest.raises(DimensionMismatch):
        check_dimension(3, 4)
    assert issubclass(DimensionMismatch, QuillError) and issubclass(DimensionMismatch, ValueError)
