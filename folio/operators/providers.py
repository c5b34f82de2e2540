"""Completion services that a translator can ask, and what they are told."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from .translation import HttpTranslator


@dataclass(frozen=True)
class Provider:
    """A service: where it is, its model, the environment variable of its key (None: needs no key), requests a minute (0: as many as one likes)."""

    url: str
    model: str
    key_variable: str | None = None
    per_minute: int = 0


#: Addresses, models, key variables and request limits of the presets.
PRESETS = {
    "local": Provider("http://127.0.0.1:8080/v1", "local-model"),
    "ollama": Provider("http://127.0.0.1:11434/v1", "qwen2.5:7b-instruct"),
    "openrouter": Provider("https://openrouter.ai/api/v1", "meta-llama/llama-3.3-70b-instruct:free", "OPENROUTER_API_KEY", 20),
    "groq": Provider("https://api.groq.com/openai/v1", "openai/gpt-oss-120b", "GROQ_API_KEY", 25),
    "gemini": Provider("https://generativelanguage.googleapis.com/v1beta/openai/", "gemini-2.5-flash", "GEMINI_API_KEY", 12),
}
DEFAULT = "openrouter"


def preset(name: str = DEFAULT, *, model: str = "", url: str = "", key_variable: str | None = None) -> Provider:
    """A preset with what is given put in its place; an unknown name is an error that tells the known ones."""
    if name not in PRESETS:
        raise ValueError(f"no provider {name!r}; there are {', '.join(sorted(PRESETS))}")
    known = PRESETS[name]
    return Provider(url or known.url, model or known.model, known.key_variable if key_variable is None else key_variable, known.per_minute)


def prompt(target: str) -> str:
    """What a service is told about a page."""
    return "\n".join([
        f"Translate the page of Markdown that the user sends into {target}. It was read from a scanned book.",
        "Answer with the translated Markdown alone, outside any code fence.",
        "Translate prose, headings, cells of tables, captions and notes; leave what already is in that language.",
        "Keep headings, lists, tables, quotes, emphasis and blank lines as they are set.",
        "Keep note marks and note ids such as [^p13-1], and image links, exactly, percent signs included: other pages refer to them.",
        "Keep numbers, units, dates, references, names of people and places, and Latin names of species.",
        "Add, shorten, mend and explain nothing, also where the scan was misread.",
    ])


def translator(provider: Provider, transport: Callable, *, tasks: int = 1, environment: Mapping[str, str] | None = None, **options) -> HttpTranslator:
    """A translator for one of so many tasks that share the provider's limit. The key comes from the environment of the process that calls; a missing one is an error."""
    key = ""
    if provider.key_variable:
        key = (os.environ if environment is None else environment).get(provider.key_variable, "")
        if not key:
            raise ValueError(f"{provider.key_variable} is not set")
    return HttpTranslator(transport, provider.url.rstrip("/") + "/chat/completions", key, provider.model, prompt, per_minute=provider.per_minute / tasks, **options)
