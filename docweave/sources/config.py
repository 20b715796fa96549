"""Corpus configuration: where documents are, and the paths of what is derived from them."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources import files


@dataclass
class CorpusConfig:
    """A corpus and its artefacts; with a run id, artefacts of runs are kept apart."""

    corpus_id: str
    docs_dir: str
    topic: str = ""
    pattern: str = "recursive"
    manifest: str = ""
    keywords: list[str] = field(default_factory=list)
    target_tokens: int = 1200
    run_id: str = ""

    def artefact(self, name: str) -> str:
        parts = [self.docs_dir.rstrip("/"), ".docweave", self.corpus_id, self.run_id, name]
        return "/".join(p for p in parts if p)

    @property
    def index(self) -> str:
        return self.artefact("index")

    @property
    def chunks(self) -> str:
        return self.artefact("chunks")

    @property
    def panel(self) -> str:
        return self.artefact("panel")


def load_config(text: str) -> CorpusConfig:
    """From JSON, or YAML where a YAML library is installed; unknown keys are ignored."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    known = CorpusConfig.__dataclass_fields__
    return CorpusConfig(**{k: v for k, v in (data or {}).items() if k in known})


def scan(spark: SparkSession, cfg: CorpusConfig) -> DataFrame:
    """The corpus's documents: its manifest, or all files below its folder."""
    return files.read_manifest(spark, cfg.manifest) if cfg.pattern == "csv_manifest" else files.scan_files(spark, cfg.docs_dir)


def acquire(spark: SparkSession, mode: str, source: str, most: int | None = None, suffix: str = "pdf") -> DataFrame:
    """Documents of a source; only local folders are implemented, in order of path."""
    if mode != "local_folder":
        raise NotImplementedError(f"source mode {mode}")
    found = files.scan_files(spark, source, suffix).orderBy("local_path")
    return found if most is None else found.limit(most)


def resolve(path: str, root: str, exists=os.path.exists) -> str:
    """An absolute path as it is; a relative one below the root if it is there, else as it is."""
    return path if os.path.isabs(path) or not exists(os.path.join(root, path)) else os.path.join(root, path)


def source_mode(c: Column) -> Column:
    """What kind of source a string names."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(low == "", "none").when(low.rlike(r"^https?://.*\.(pdf|zip)$"), "url_file").when(low.rlike("^https?://"), "web").when(low.rlike("^s3[an]?://"), "object_store")
        .when(low.rlike(r"\.csv$"), "csv_manifest").when(low.rlike(r"^(/|\./|~|[a-z]:[\\/])"), "local_folder").otherwise("query")
    )


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "_", text.lower()).strip("_")
