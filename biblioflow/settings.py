"""Settings from the environment or a file of ``NAME=value`` lines."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

#: What the variables begin with.
PREFIX = "BIBLIOFLOW_"


@dataclass(frozen=True)
class Settings:
    """Every field is read from ``BIBLIOFLOW_<NAME>``; empty values count as absent."""

    opml: str = "feeds.opml"
    user_agent: str = "biblioflow"
    rss_timeout: int = 30
    rss_max_concurrent: int = 10
    mail_query: str | None = None
    mail_max_results: int = 50
    mail_mark_as_read: bool = False
    mail_trash_after_process: bool = True
    mail_processed_label: str | None = None
    mail_sender_filter: str | None = None
    mail_sender_map: str | None = None
    research_prompt: str | None = None
    research_prompt_file: str | None = None
    judge_batch_size: int = 50
    judge_max_tokens: int = 1000
    api_timeout: int = 45
    api_user_agent: str = "biblioflow"
    polite_email: str | None = None
    crossref_email: str | None = None
    crossref_timeout: int | None = None
    crossref_user_agent: str | None = None
    openalex_email: str | None = None
    openalex_api_key: str | None = None
    openalex_timeout: int | None = None
    openalex_user_agent: str | None = None
    openalex_max_requests_per_second: int = 10
    library_id: str | None = None
    library_api_key: str | None = None
    library_type: str = "user"
    library_collection: str | None = None

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None, file: str | None = None) -> Settings:
        """Settings of the file, with the environment's values over them; values of the wrong type raise."""
        held = (parse_env_file(Path(file).read_text(encoding="utf-8")) if file and Path(file).exists() else {}) | dict(os.environ if env is None else env)
        found = {}
        for f in fields(cls):
            raw = (held.get(PREFIX + f.name.upper()) or "").strip()
            if raw:
                found[f.name] = _typed(f.name, str(f.type), raw)
        return cls(**found)

    def catalog(self, name: str) -> dict:
        """Mail address, time limit and user agent for a catalog, its own before the general ones."""
        own = lambda key: getattr(self, f"{name}_{key}")
        return {"email": own("email") or self.polite_email, "timeout": own("timeout") or self.api_timeout, "user_agent": own("user_agent") or self.api_user_agent}

    def prompt(self) -> str | None:
        """The research prompt: the text, else what a file holds, else None."""
        if text := (self.research_prompt or "").strip():
            return text
        file = Path(self.research_prompt_file or "")
        return (file.read_text(encoding="utf-8").strip() or None) if self.research_prompt_file and file.exists() else None


def parse_env_file(text: str) -> dict[str, str]:
    """``NAME=value`` lines; comments, quotes around values and a leading ``export`` are understood."""
    found = {}
    for line in text.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not name.startswith("#"):
            value = value.strip()
            found[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return found


def _typed(name: str, kind: str, raw: str) -> object:
    if kind.startswith("int"):
        return int(raw)
    if kind.startswith("bool"):
        if raw.lower() not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
            raise ValueError(f"{name} must be true or false")
        return raw.lower() in ("1", "true", "yes", "on")
    return raw
