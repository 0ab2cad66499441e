"""Settings from the environment, read anew on every call."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Where the lake is, how its layers are named, and the simulated fleet's defaults."""

    backend: str = "local"
    root: str = ""
    bronze: str = "raw"
    silver: str = "silver"
    gold: str = "gold"
    fleet_size: int = 500
    seed: int = 42
    #: Spark settings that the backend's file system needs, as ``spark.hadoop.`` keys.
    storage: dict[str, str] = field(default_factory=dict)

    @property
    def is_local(self) -> bool:
        return self.backend == "local"

    def prefixes(self) -> dict[str, str]:
        return {"bronze": self.bronze, "silver": self.silver, "gold": self.gold}


def _azure(env: dict[str, str]) -> tuple[str, dict[str, str]]:
    """Root and credentials of a container, from a storage account's connection string."""
    text, container = env.get("AZURE_STORAGE_CONNECTION_STRING", ""), env.get("AZURE_BLOB_CONTAINER", "fleet-lake")
    parts = dict(p.split("=", 1) for p in text.split(";") if "=" in p)
    account, key = parts.get("AccountName"), parts.get("AccountKey")
    if not account or not container:
        raise ValueError("the azure backend needs AZURE_STORAGE_CONNECTION_STRING (with AccountName) and AZURE_BLOB_CONTAINER")
    host = f"{account}.dfs.{parts.get('EndpointSuffix', 'core.windows.net')}"
    return f"abfss://{container}@{host}", {f"spark.hadoop.fs.azure.account.key.{host}": key} if key else {}


def _number(env: dict[str, str], name: str, default: int) -> int:
    text = (env.get(name) or "").strip()
    try:
        value = int(text or default)
    except ValueError:
        raise ValueError(f"{name} is a whole number, not {text!r}") from None
    if name == "FLEET_SIZE" and value < 1:
        raise ValueError("FLEET_SIZE is at least 1")
    return value


def get_settings(env: dict[str, str] | None = None) -> Settings:
    """LAKE_BACKEND (local or azure), LAKE_LOCAL_ROOT or AZURE_STORAGE_CONNECTION_STRING and
    AZURE_BLOB_CONTAINER, BRONZE_PREFIX, SILVER_PREFIX, GOLD_PREFIX, FLEET_SIZE, GENERATOR_SEED.

    A local root that is not absolute is taken from the working directory; one with a scheme
    (``hdfs://...``) is taken as it is.
    """
    env = dict(os.environ) if env is None else env
    text = lambda name, default: (env.get(name) or default).strip().strip("/" if name.endswith("PREFIX") else None)
    backend, storage = text("LAKE_BACKEND", "local").lower(), {}
    if backend == "local":
        root = text("LAKE_LOCAL_ROOT", "./data")
        root = root if "://" in root else "file://" + str(Path(root).expanduser().absolute())
    elif backend == "azure":
        root, storage = _azure(env)
    else:
        raise ValueError(f"LAKE_BACKEND is local or azure, not {backend!r}")
    return Settings(
        backend,
        root,
        text("BRONZE_PREFIX", "raw"),
        text("SILVER_PREFIX", "silver"),
        text("GOLD_PREFIX", "gold"),
        _number(env, "FLEET_SIZE", 500),
        _number(env, "GENERATOR_SEED", 42),
        storage,
    )
