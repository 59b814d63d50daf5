"""Run settings from arguments, environment and what an index recorded."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, MutableMapping, Sequence
from dataclasses import dataclass, field

from ..functions import models

# Words of a Boolean setting, and names of settings.
TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}
ANSWER, REWRITE = "RAG_LLM", "RAG_QUERY_REWRITE"
CALLS, ENHANCED_CALLS = "RAG_EVAL", "RAG_ENHANCED_EVAL"
EMBEDDING_MODEL, EMBEDDING_DEVICE = "RAG_EMBEDDING_MODEL", "RAG_EMBEDDING_DEVICE"
RERANKER_MODEL, RERANKER_DEVICE = "RAG_RERANKER_MODEL", "RAG_RERANKER_DEVICE"
GATE = "RAG_ENHANCED_LLM_QUERY_REWRITE"
USE_REWRITE = "RAG_ENHANCED_USE_LLM_QUERY_REWRITE"

Env = Mapping[str, str]


def optional_bool(value: str | None) -> bool | None:
    """None for a missing or blank setting; anything unknown is an error."""
    if value is None or not value.strip():
        return None
    word = value.strip().lower()
    if word in TRUE | FALSE:
        return word in TRUE
    raise ValueError(f"not a Boolean setting: {value!r}")


def flag(name: str, default: bool, env: Env = os.environ) -> bool:
    found = optional_bool(env.get(name))
    return default if found is None else found


def first_set(names: Sequence[str], default: str | None = None, env: Env = os.environ) -> str | None:
    """The first of several environment settings that is not blank."""
    return next((env[n] for n in names if env.get(n, "").strip()), default)


def number(names: Sequence[str], default: float, env: Env = os.environ, least: float | None = None) -> float:
    """A number from the first setting that is not blank, not below `least`."""
    found = float(first_set(names, str(default), env))
    return found if least is None else max(least, found)


def resolve(chosen: str | None, recorded: str | None, default: str) -> str:
    """A model's name: as chosen, else as an index recorded it, else the default."""
    return chosen or recorded or default


resolve_device = models.resolve_device


def embedding_runtime(recorded: Mapping[str, object], default: str, env: Env = os.environ, device: str | None = None) -> dict[str, str | None]:
    """Model and device of an index: the setting, else what the index recorded, else the default."""
    known = recorded.get("embedding_model")
    return {
        "model": resolve(first_set([EMBEDDING_MODEL], None, env), known, default),
        "device": models.device_for(device or env.get(EMBEDDING_DEVICE)),
        "recorded_model": known,
    }


def sane_environment(env: MutableMapping[str, str] = os.environ) -> list[str]:
    """Takes a thread count that is no positive number out of the environment; the names of what went."""
    name = "OMP_NUM_THREADS"
    value = env.get(name)
    if value is None or (value.strip().isdecimal() and int(value) >= 1):
        return []
    del env[name]
    return [name]


def thinking_options(enabled: bool | None, extra: Mapping[str, object] | None = None) -> dict[str, object]:
    """Extra request fields, with one of models that can be told whether to reason first."""
    return dict(extra or {}) | ({} if enabled is None else {"enable_thinking": enabled})


@dataclass(frozen=True)
class ChatSettings:
    """A chat endpoint and what is asked of it.  There is no default endpoint and no default key."""

    base_url: str | None = None
    model: str = "default"
    api_key: str = field(default="", repr=False)
    provider: str = ""
    temperature: float = 0.1
    max_tokens: int | None = None
    timeout: float = 120.0
    enable_thinking: bool | None = False

    @classmethod
    def read(cls, prefix: str = ANSWER, env: Env = os.environ, base: ChatSettings | None = None) -> ChatSettings:
        """Settings with a prefix; what is not set is taken from `base`."""
        base = base or cls()
        text = lambda key, default: first_set([f"{prefix}_{key}"], default, env)
        tokens = text("MAX_TOKENS", None)
        return cls(
            base_url=text("BASE_URL", base.base_url),
            model=text("MODEL", base.model),
            api_key=text("API_KEY", base.api_key),
            provider=text("PROVIDER", base.provider),
            temperature=float(text("TEMPERATURE", base.temperature)),
            max_tokens=int(tokens) if tokens else base.max_tokens,
            timeout=float(text("TIMEOUT", base.timeout)),
            enable_thinking=base.enable_thinking if (found := optional_bool(env.get(f"{prefix}_ENABLE_THINKING"))) is None else found,
        )

    def options(self) -> dict[str, object]:
        """The fields of a completion request beside its messages."""
        limit = {} if self.max_tokens is None else {"max_tokens": self.max_tokens}
        return {"model": self.model, "temperature": self.temperature} | limit | thinking_options(self.enable_thinking)

    def maker(self) -> Callable[[], object] | None:
        """What makes the model in a task; None without an endpoint."""
        if not self.base_url:
            return None
        return models.maker("chat", base_url=self.base_url, options=self.options(), api_key=self.api_key, timeout=self.timeout)


@dataclass(frozen=True)
class CallSettings:
    """How fast a job may call a model: all its tasks together, and each task at a time."""

    requests_per_minute: float | None = 60
    in_flight: int = 4
    attempts: int = 5

    @classmethod
    def read(cls, env: Env = os.environ, enhanced: bool = False) -> CallSettings:
        own = [ENHANCED_CALLS] * enhanced + [CALLS]
        return cls(
            requests_per_minute=number([f"{p}_RPM_LIMIT" for p in own], 60, env),
            in_flight=int(number([f"{p}_MAX_CONCURRENT" for p in own], 4, env, 1)),
            attempts=int(number([f"{ANSWER}_MAX_RETRIES"], 5, env, 1)),
        )


@dataclass(frozen=True)
class GateSettings:
    """When a query is worth a call to the rewriting model."""

    enabled: bool = True
    mode: str = "auto"
    max_chars: int = 160
    max_words: int = 24

    @classmethod
    def read(cls, env: Env = os.environ) -> GateSettings:
        return cls(
            enabled=flag(USE_REWRITE, True, env),
            mode=first_set([f"{GATE}_MODE"], "auto", env).strip().lower(),
            max_chars=int(number([f"{GATE}_AUTO_MAX_CHARS"], 160, env, 1)),
            max_words=int(number([f"{GATE}_AUTO_MAX_WORDS"], 24, env, 1)),
        )
