"""Deletion, holds and purge of what a `versions.Store` holds, each in one commit with its row in the audit table.

The store has documents (workspace and the key), any tables that share their key, and workspaces' holds as rows of ``holds`` whose key is `hold_key`. The audit table is
`versions.CHAINED`: rows are only added, and each addition's digest covers the one before, so `Store.broken_links` finds a row that was changed or removed.

Defined cases: an action on what isn't there raises `QuillError` and leaves no row; a held workspace raises `LegalHold`, a wrong token `WrongToken`, before anything is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.errors import QuillError
from quillspark.operators.governance import LegalHold, WrongToken, token
from quillspark.operators.versions import CHAINED, Store, Version

HOLDS = "workspace string, is_legal_hold boolean"


def _row(store: Store, key: DataFrame, action: str, workspace: str, actor: str, detail: str) -> dict[str, DataFrame]:
    named = [F.lit(x).alias(n) for n, x in (("action", action), ("workspace", workspace), ("actor", actor), ("detail", detail))]
    return {CHAINED: key.select(F.col(store.key), *named, F.current_timestamp().alias("at"))}


def hold_key(store: Store, workspace: str) -> DataFrame:
    """The key under which a workspace's hold is kept: a hash of its name, of the type of the documents' keys."""
    kind = dict(store.read("documents").dtypes).get(store.key, "bigint")
    value = F.lit(f"hold:{workspace}") if kind == "string" else F.xxhash64(F.lit("hold"), F.lit(workspace))
    return store.spark.range(1).select(value.alias(store.key))


def is_held(store: Store, workspace: str, version: Version | None = None) -> bool:
    rows = store.read("holds", version, f"{store.key} long, {HOLDS}")
    return not rows.where((F.col("workspace") == workspace) & F.col("is_legal_hold")).isEmpty()


def _checked(store: Store, action: str, name: str | int, typed: str, workspace: str, version: Version) -> None:
    if typed != token(action, name):
        raise WrongToken(f"{action} of {name} needs {token(action, name)}")
    if is_held(store, workspace, version):
        raise LegalHold(f"workspace {workspace} is under legal hold")


def _removed(store: Store, keys: DataFrame, version: Version, action: str, workspace: str, actor: str, detail: str, audited: DataFrame) -> Version:
    tables = {t: store.read(t, version).limit(0) for t in version.folders if t not in (CHAINED, "holds")}
    both = keys.unionByName(hold_key(store, workspace))  # a hold that is set meanwhile is a conflict
    return store.replace(tables, both, base=version, added=_row(store, audited, action, workspace, actor, detail))


def delete_document(store: Store, workspace: str, document: int | str, typed: str, actor: str) -> Version:
    """Removes a document and all rows of its key."""
    version = store.version()
    _checked(store, "DELETE", document, typed, workspace, version)
    keys = store.read("documents", version).where(F.col("workspace").eqNullSafe(workspace) & F.col(store.key).eqNullSafe(document)).select(store.key).distinct()
    if keys.isEmpty():
        raise QuillError(f"no document {document} in {workspace}")
    return _removed(store, keys, version, "delete", workspace, actor, str(document), keys)


def purge(store: Store, workspace: str, typed: str, actor: str) -> Version:
    """Removes all documents of a workspace; one audit row, under the workspace's own key, says how many."""
    version = store.version()
    _checked(store, "PURGE", workspace, typed, workspace, version)
    keys = store.read("documents", version).where(F.col("workspace").eqNullSafe(workspace)).select(store.key).distinct()
    n = keys.count()
    if not n:
        raise QuillError(f"no documents in {workspace}")
    return _removed(store, keys, version, "purge", workspace, actor, f"{n} documents", hold_key(store, workspace))


def hold(store: Store, workspace: str, on: bool, actor: str, typed: str = "") -> Version:
    """Sets a hold, or releases it with the token for it."""
    if not on and typed != token("RELEASE_HOLD", workspace):
        raise WrongToken(f"release of {workspace} needs {token('RELEASE_HOLD', workspace)}")
    key = hold_key(store, workspace)
    rows = key.withColumns({"workspace": F.lit(workspace), "is_legal_hold": F.lit(on)})
    return store.replace({"holds": rows}, key, added=_row(store, key, "hold" if on else "release", workspace, actor, ""))


def audit(store: Store, workspace: str | None = None) -> DataFrame:
    """Audit rows, the newest first."""
    rows = store.read(CHAINED, None, f"{store.key} long, action string, workspace string, actor string, detail string, at timestamp")
    return (rows if workspace is None else rows.where(F.col("workspace") == workspace)).orderBy(F.desc("at"))
