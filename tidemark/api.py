"""Named tools, resources and prompts over an engine, with arguments and answers as JSON values; errors are answers, too."""

from __future__ import annotations

import dataclasses
import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from tidemark.config import Settings
from tidemark.engine import Engine

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    run: Callable[..., dict]
    #: Name and type of each argument; those in ``required`` must be given.
    arguments: Mapping[str, str] = dataclasses.field(default_factory=dict)
    required: tuple[str, ...] = ()


def as_json(settings: Settings) -> dict:
    """All settings; each vault shows what it leaves out, if that is nothing."""
    return dataclasses.asdict(settings, dict_factory=lambda pairs: {k: dict(v) if isinstance(v, Mapping) else list(v) if isinstance(v, tuple) else v for k, v in pairs})


class Service:
    """What a server or another program calls: ``call`` for tools, ``read`` for resources, ``prompt`` for prompts."""

    def __init__(self, engine: Engine, config_path: str = "config.yaml"):
        self.engine, self.config_path = engine, config_path
        search = {"query": "string", "mode": "string", "top_k": "integer", "alpha": "number", "beta": "number", "vaults": "array"}
        self.tools = {
            t.name: t
            for t in (
                Tool("search", "Ranked search by meaning and words", self._search, search, ("query",)),
                Tool("scan_index", "Take in what changed on disk", self._scan),
                Tool("rebuild_index", "Build the index anew", lambda: {"status": "completed", **engine.rebuild()}),
                Tool("stats", "Counts and sizes of the index", engine.statistics),
                Tool("config", "All settings", lambda: as_json(engine.settings)),
                Tool("reload_config", "Read the settings again", self._reload),
                Tool("maintenance", "Remove deleted rows and compact", self._maintain, {"dry_run": "boolean"}),
            )
        }
        self.resources = ("vault/{vault_name}", "file/{file_id}", "chunks/{file_id}")
        self.prompts = {"search_with_context": ("query",), "summarize_document": ("file_path",)}

    def call(self, name: str, arguments: Mapping[str, Any] | None = None) -> dict:
        """A tool's answer; ``{"error": ...}`` if it failed, the tool or an argument is unknown, or one is missing."""
        given = dict(arguments or {})
        try:
            tool = self.tools.get(name)
            if tool is None:
                raise ValueError(f"unknown tool {name}")
            if wrong := [k for k in given if k not in tool.arguments]:
                raise ValueError(f"{name} has no argument {', '.join(wrong)}")
            if missing := [k for k in tool.required if k not in given]:
                raise ValueError(f"{name} needs {', '.join(missing)}")
            return tool.run(**given)
        except Exception as error:  # whatever failed, the caller gets an answer and the log the trace
            log.error("%s failed: %s", name, error, exc_info=True)
            return {"error": str(error)}

    def _search(self, query: str, **options) -> dict:
        if options.get("mode") == "hybrid":
            del options["mode"]
        try:
            found = self.engine.search(query, **options)
        except ValueError as error:
            return {"error": str(error), "query": query, "total": 0, "results": []}
        return {"query": query, "total": len(found), "results": found}

    def _scan(self) -> dict:
        counts = self.engine.scan_index()
        return {"status": "success", "summary": ", ".join(f"{k}: {n}" for k, n in counts.items()), **counts}

    def _reload(self) -> dict:
        return {"status": "reloaded", "retrieval": dict(self.engine.reload_config(self.config_path).retrieval)}

    def _maintain(self, dry_run: bool = False) -> dict:
        if dry_run:
            return {"status": "dry_run", "stats": self.engine.maintenance(dry_run=True)}
        done = self.engine.maintenance(force=True)
        return {"status": "completed", "reclaimed_space_mb": round(done["file_size_mb"] - done["file_size_after_mb"], 2)}

    def read(self, uri: str) -> Any:
        """A resource; one of unknown kind is a ValueError, one that can't be had an answer with ``error``."""
        if not any(uri.split("://")[-1].startswith(r.split("{")[0]) for r in self.resources):
            raise ValueError(f"unknown resource {uri}")
        try:
            return self.engine.resource(uri)
        except ValueError as error:
            return {"error": str(error)}

    def prompt(self, name: str, arguments: Mapping[str, Any]) -> str:
        """The text of a prompt; weights come from the arguments, else from the settings."""
        if name not in self.prompts:
            raise ValueError(f"unknown prompt {name}")
        if name == "search_with_context":
            number = {k: float(arguments[k]) for k in ("alpha", "beta") if arguments.get(k) not in (None, "")}
            return self.engine.prompt_search(arguments.get("query", ""), int(arguments.get("top_k") or 5), arguments.get("vaults"), **number)
        try:
            return self.engine.prompt_summary(arguments.get("file_path", ""))
        except ValueError as error:
            return str(error)
