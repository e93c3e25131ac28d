"""Language models behind HTTP, as completers for rewrite.run_jobs. Only the standard library is used."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from leesmaat.operators.rewrite import PROVIDERS

# Where each kind of provider listens, the variable that holds its key, and its dialect.
ENDPOINTS = {
    "openai": ("https://api.openai.com/v1/chat/completions", "OPENAI_API_KEY", "openai"), "mistral": ("https://api.mistral.ai/v1/chat/completions", "MISTRAL_API_KEY", "openai"),
    "anthropic": ("https://api.anthropic.com/v1/messages", "ANTHROPIC_API_KEY", "anthropic"), "ollama": ("http://localhost:11434/api/chat", None, "ollama"),
    "hetzner": (None, "HETZNER_API_KEY", "openai"), "mlx": ("http://localhost:8080/v1/chat/completions", None, "openai"),
}


@dataclass
class HttpModel:
    """A model of one provider; url and model default to the provider's. Errors of the service are raised."""

    provider: str
    model: str = ""
    url: str | None = None
    key: str | None = None
    temperature: float | None = None
    timeout: float = 300.0

    def __post_init__(self):
        if self.provider not in ENDPOINTS:
            raise ValueError(f"unknown provider {self.provider!r}; known are {', '.join(sorted(ENDPOINTS))}")
        url, variable, self.dialect = ENDPOINTS[self.provider]
        name, _, temperature = PROVIDERS[self.provider]
        self.url, self.model = self.url or url, self.model or name
        self.key = self.key or (os.environ.get(variable) if variable else None)
        self.temperature = temperature if self.temperature is None else self.temperature
        if not self.url:
            raise ValueError(f"{self.provider} needs a url")

    def request(self, system: str, user: str, max_tokens: int) -> tuple[dict, dict]:
        """Headers and body of a call."""
        said = [{"role": "user", "content": user}]
        told = [{"role": "system", "content": system}] if system else []
        heat = {} if self.temperature is None else {"temperature": self.temperature}
        if self.dialect == "anthropic":
            return {"x-api-key": self.key or "", "anthropic-version": "2023-06-01"}, {"model": self.model, "max_tokens": max_tokens, "messages": said} | ({"system": system} if system else {}) | heat
        if self.dialect == "ollama":
            return {}, {"model": self.model, "messages": told + said, "stream": False, "options": {"num_predict": max_tokens} | heat}
        return {"Authorization": f"Bearer {self.key}"} if self.key else {}, {"model": self.model, "messages": told + said, "max_tokens": max_tokens} | heat

    def complete(self, system: str, user: str, max_tokens: int) -> str:
        headers, body = self.request(system, user, max_tokens)
        call = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
        with urllib.request.urlopen(call, timeout=self.timeout) as r:
            answer = json.load(r)
        if self.dialect == "anthropic":
            return "".join(x.get("text", "") for x in answer["content"])
        return (answer["message"] if self.dialect == "ollama" else answer["choices"][0]["message"])["content"] or ""


def model(provider: str, **options) -> Callable[[], HttpModel]:
    """A factory for run_jobs: every worker makes its own model; keys come from its environment unless given."""
    HttpModel(provider, **options)  # mistakes show here, not in a task
    return lambda: HttpModel(provider, **options)


def concurrent(provider: str) -> bool:
    """Whether a provider takes calls side by side; jobs of one that doesn't belong in a single partition."""
    return PROVIDERS[provider][1]
