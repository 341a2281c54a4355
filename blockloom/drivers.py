"""Enrichment drivers: what a driver offers, a registry, one HTTP driver with vendor presets, and tenants.

A driver is a callable of a prompt, so it can be handed to operators.escalation.call and runs inside tasks: it holds plain
values and pickles. Each task has its own copy, and so its own circuit breaker.
"""

from __future__ import annotations

import asyncio
import json
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import AsyncIterator, Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from .operators.breaker import CLOSED, State, step


class DriverError(RuntimeError):
    """A driver can't be made, or can't answer."""


@dataclass
class Breaker:
    """Opens after `failures` failures within `window` seconds, for `recovery` seconds; a success closes it."""

    failures: int = 3
    recovery: float = 30.0
    window: float = 10.0
    clock: Callable[[], float] = time.monotonic
    _state: State = CLOSED

    def allows(self) -> bool:
        opened = self._state[2]
        if opened is not None and self.clock() - opened >= self.recovery:
            self.success()
        return self._state[2] is None

    def success(self) -> None:
        self._state = CLOSED

    def failure(self) -> None:
        self._state = step(self._state, self.clock(), False, self.failures, self.window, self.recovery)


class Driver:
    """generate() is all a driver must have: streaming and waiting without blocking follow from it."""

    name = "driver"

    def generate(self, prompt: str, metadata: dict | None = None) -> dict:
        raise NotImplementedError

    def __call__(self, prompt: str) -> dict:
        return self.generate(prompt)

    def stream(self, prompt: str, metadata: dict | None = None) -> Iterator[dict]:
        """Events of an answer as they come; the whole answer as one where a driver can't stream."""
        yield self.generate(prompt, metadata)

    @property
    def streams(self) -> bool:
        return type(self).stream is not Driver.stream

    async def agenerate(self, prompt: str, metadata: dict | None = None) -> dict:
        return await asyncio.to_thread(self.generate, prompt, metadata)

    async def astream(self, prompt: str, metadata: dict | None = None) -> AsyncIterator[dict]:
        events, end = self.stream(prompt, metadata), object()
        while (event := await asyncio.to_thread(next, events, end)) is not end:
            yield event


@dataclass
class Called(Driver):
    """A plain callable as a driver."""

    answer: Callable[[str], dict]
    name: str = "callable"

    def generate(self, prompt: str, metadata: dict | None = None) -> dict:
        return self.answer(prompt)


# fixed values: statuses that are tried again besides 5xx
RETRIED = (408, 409, 429)
Transport = Callable[[str, dict, bytes, float], Iterator[bytes]]


def over_http(url: str, headers: dict, body: bytes, timeout: float) -> Iterator[bytes]:
    """Lines of the answer to a POST."""
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:  # noqa: S310
        yield from answer


def passing(error: Exception) -> bool:
    """Whether a failure may pass by itself: a status of RETRIED or 5xx, or no answer at all."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code in RETRIED or error.code >= 500
    return isinstance(error, (urllib.error.URLError, TimeoutError, ConnectionError))


def events(lines: Iterator[bytes]) -> Iterator[dict]:
    """Events of a stream: each line, after `data: ` if that stands before it, as JSON until [DONE]; other lines are left out."""
    for line in lines:
        text = line.decode("utf-8", "replace").strip().removeprefix("data: ")
        if text == "[DONE]":
            return
        try:
            yield json.loads(text)
        except ValueError:
            continue


@dataclass
class HttpDriver(Driver):
    """POSTs a JSON request and returns the JSON answer, with retries and a circuit breaker. `transport` can be replaced.

    observe, if given, gets a dict for each attempt: driver, ok, latency_ms, request_bytes, response_bytes, error; these are
    rows of operators.control.call_metrics.
    """

    url: str
    body: Callable[[str, dict | None], dict]
    headers: dict[str, str] = field(default_factory=dict)
    name: str = "http"
    retries: int = 2
    base: float = 0.5
    most: float = 8.0
    jitter: float = 0.5
    timeout: float = 30.0
    can_stream: bool = True
    breaker: Breaker | None = field(default_factory=Breaker)
    transport: Transport = over_http
    observe: Callable[[dict], None] | None = None

    def _attempts(self, body: dict, read: Callable[[Iterator[bytes]], Iterator[dict]]) -> Iterator[dict]:
        """What `read` makes of the answer of the first attempt that succeeds. Once it has given something there is no other."""
        if self.breaker and not self.breaker.allows():
            raise DriverError(f"driver {self.name!r}: its circuit breaker is open")
        data = json.dumps(body).encode()
        for left in range(self.retries, -1, -1):
            start, seen, given = time.perf_counter(), [0], False

            def counted(lines: Iterator[bytes], seen: list[int] = seen) -> Iterator[bytes]:
                for line in lines:
                    seen[0] += len(line)
                    yield line

            def told(error: str | None, start: float = start, seen: list[int] = seen) -> None:
                if self.observe:
                    self.observe({"driver": self.name, "ts": time.time(), "ok": error is None, "latency_ms": (time.perf_counter() - start) * 1000, "request_bytes": len(data), "response_bytes": seen[0], "error": error})

            try:
                for event in read(counted(self.transport(self.url, self.headers, data, self.timeout))):
                    given = True
                    yield event
            except (OSError, ValueError) as e:
                told(type(e).__name__)
                if self.breaker:
                    self.breaker.failure()
                if given or not left or not passing(e):
                    raise DriverError(f"driver {self.name!r}: {e}") from e
                time.sleep(min(self.base * 2 ** (self.retries - left), self.most) + random.uniform(0, self.jitter))
            else:
                told(None)
                if self.breaker:
                    self.breaker.success()
                return

    def generate(self, prompt: str, metadata: dict | None = None) -> dict:
        return next(iter(list(self._attempts(self.body(prompt, metadata), lambda lines: iter([json.loads(b"".join(lines))])))))

    def stream(self, prompt: str, metadata: dict | None = None) -> Iterator[dict]:
        if not self.can_stream:
            yield self.generate(prompt, metadata)
            return
        yield from self._attempts(self.body(prompt, metadata) | {"stream": True}, events)

    @property
    def streams(self) -> bool:
        return self.can_stream


Make = Callable[[dict], Callable[[str], dict]]


@dataclass
class Entry:
    make: Make
    metadata: dict


_REGISTRY: dict[str, Entry] = {}


def register(*names: str, make: Make, metadata: dict | None = None, overwrite: bool = False) -> None:
    """Make a driver known under names, which don't tell capitals apart. A taken name needs `overwrite`."""
    if not names:
        raise ValueError("a driver needs a name")
    for name in map(str.lower, names):
        if name in _REGISTRY and not overwrite:
            if _REGISTRY[name].make is make:
                continue
            raise DriverError(f"there is a driver {name!r} already")
        _REGISTRY[name] = Entry(make, dict(metadata or {}))


def unregister(name: str) -> None:
    _REGISTRY.pop(name.lower(), None)


def available() -> list[str]:
    return sorted(_REGISTRY)


def _entry(name: str) -> Entry:
    if name.lower() not in _REGISTRY:
        raise DriverError(f"no driver {name!r}; there are {available()}")
    return _REGISTRY[name.lower()]


def metadata(name: str) -> dict:
    return dict(_entry(name).metadata)


def create(name: str, settings: dict | None = None) -> Driver:
    made = _entry(name).make(settings or {})
    return made if isinstance(made, Driver) else Called(made, name)


@dataclass(frozen=True)
class Vendor:
    """How a vendor takes requests: endpoint, header and prefix of the key, what must be set, and the shape of the body."""

    endpoint: str
    path: str = ""
    header: str = "Authorization"
    prefix: str = "Bearer "
    needs: tuple[str, ...] = ("api_key", "model")
    shape: str = "chat"
    aliases: tuple[str, ...] = ()
    retries: int = 2
    can_stream: bool = True
    guarded: bool = True
    extra: tuple[tuple[str, str], ...] = ()
    defaults: tuple[tuple[str, float], ...] = ()


# fixed values: where vendors take requests, how they take a key, and what they are asked for by default
USUAL = (("max_tokens", 512), ("temperature", 0.2))
VENDORS = {
    "openai": Vendor("https://api.openai.com/v1", "/chat/completions", defaults=USUAL),
    "anthropic": Vendor("https://api.anthropic.com/v1", "/messages", "x-api-key", "", shape="messages", extra=(("anthropic-version", "2023-06-01"),), defaults=(("max_tokens", 512), ("temperature", 0.1))),
    "azure": Vendor("", "/openai/deployments/{deployment}/chat/completions?api-version={api_version}", "api-key", "", ("endpoint", "deployment", "api_version", "api_key"), defaults=USUAL),
    "vllm": Vendor("http://localhost:8000", "/v1/chat/completions", needs=("model",), defaults=USUAL),
    "mistral": Vendor("https://api.mistral.ai/v1/chat/completions", can_stream=False),
    "google": Vendor("https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "", "x-goog-api-key", "", shape="contents", aliases=("googleai", "vertex"), can_stream=False),
    "xai": Vendor("https://api.x.ai/v1/chat/completions", aliases=("grok",), can_stream=False),
    "bedrock": Vendor("https://bedrock-runtime.amazonaws.com/model/{model}/invoke", "", "x-api-key", "", aliases=("aws",), can_stream=False),
    "proxy": Vendor("", needs=("endpoint", "api_key", "model"), can_stream=False),
    "docker": Vendor("", needs=("endpoint",), retries=0, can_stream=False, guarded=False, defaults=USUAL),
}


@dataclass(frozen=True)
class Body:
    """A vendor's request of a prompt."""

    shape: str
    settings: tuple[tuple[str, object], ...]

    def __call__(self, prompt: str, metadata: dict | None = None) -> dict:
        s = {k: v for k, v in self.settings if v is not None}
        if self.shape == "contents":
            return {"model": s.get("model"), "contents": [{"role": "user", "parts": [{"text": prompt}]}]} | ({"safetySettings": metadata} if metadata else {})
        system = s.pop("system_prompt", None)
        apart = self.shape == "messages"  # the system prompt has a place of its own
        messages = [{"role": "system", "content": system}] * bool(system and not apart) + [{"role": "user", "content": prompt}]
        return s | {"messages": messages} | ({"system": system} if system and apart else {}) | ({"metadata": dict(metadata)} if metadata else {})


def _number(s: dict, key: str, default: float) -> float:
    return float(default if s.get(key) is None else s[key])


def _vendor(name: str) -> Make:
    def make(s: dict) -> Driver:
        v = VENDORS[name]
        s = dict(v.defaults) | s | {"endpoint": s.get("endpoint") or s.get("url") or s.get("base_url") or v.endpoint}
        missing = [k for k in v.needs if not s.get(k)]
        if missing:
            raise DriverError(f"driver {name!r} needs {', '.join(missing)}")
        url = s["endpoint"].rstrip("/") + v.path
        url = re.sub(r"\{(\w+)\}", lambda m: str(s.get(m[1], "")), url)
        key = {s.get("api_key_header", v.header): f"{s.get('api_key_prefix', v.prefix) or ''}{s['api_key']}"} if s.get("api_key") else {}
        agent = {"User-Agent": str(s["user_agent"])} if s.get("user_agent") else {}
        headers = {"Content-Type": "application/json"} | dict(v.extra) | key | agent | {str(k): str(x) for k, x in (s.get("headers") or {}).items()}
        breaker = Breaker(max(1, int(_number(s, "circuit_breaker_failures", 3))), max(0.1, _number(s, "circuit_breaker_recovery", 30)), max(0.1, _number(s, "circuit_breaker_window", 10)))
        body = Body(v.shape, tuple((k, s.get(k)) for k in ("model", "temperature", "max_tokens", "system_prompt")))
        return HttpDriver(
            url, body, headers, name, int(_number(s, "max_retries", v.retries)), _number(s, "retry_backoff_base", 0.5), _number(s, "retry_backoff_max", 8), _number(s, "retry_jitter", 0.5), _number(s, "timeout", 30),
            v.can_stream, breaker if v.guarded else None, s.get("transport") or over_http, s.get("observe"),
        )

    return make


for _name, _v in VENDORS.items():
    register(_name, *_v.aliases, make=_vendor(_name), metadata={"provider": _name, "transport": "rest", "streams": _v.can_stream})


def _echo(_: dict) -> Callable[[str], dict]:
    return lambda prompt: {"model": "echo", "choices": [{"index": 0, "finish_reason": "stop", "message": {"role": "assistant", "content": prompt}}], "usage": {}}


register("echo", make=_echo, metadata={"provider": "echo", "transport": "local"})


def expand(value):
    """$NAME, ${NAME} and ${NAME:default} from the environment, in strings at any depth; a bare unknown $NAME stays."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if not isinstance(value, str):
        return value
    return re.sub(r"\$(?:(\w+)|\{(\w+)(?::([^}]*))?\})", lambda m: os.environ.get(m[1], m[0]) if m[1] else os.environ.get(m[2], m[3] or ""), value)


@dataclass
class Tenants:
    """Tenant settings, one YAML file per tenant in a folder (driver, settings), and the drivers made from them.

    defaults are settings for all drivers: a recipe's settings win over the tenant's, and those over the defaults. A driver
    is made once for the same settings, so that its breaker remembers.
    """

    folder: str
    default: str = field(default_factory=lambda: os.environ.get("BLOCKLOOM_TENANT", "default"))
    defaults: dict = field(default_factory=dict)
    _made: dict[str, Driver] = field(default_factory=dict)

    def names(self) -> list[str]:
        return sorted({p.stem for p in Path(self.folder).glob("*") if p.suffix in (".yaml", ".yml")})

    def load(self, tenant: str | None = None) -> dict:
        """A tenant's settings; none for the default tenant where it has no file."""
        name = tenant or self.default
        for path in (Path(self.folder) / f"{name}{end}" for end in (".yaml", ".yml")):
            if path.exists():
                own = expand(yaml.safe_load(path.read_text()) or {})
                if not own.get("driver"):
                    raise DriverError(f"tenant {name!r} names no driver")
                return own
        if tenant and tenant != self.default:
            raise DriverError(f"no tenant {tenant!r} in {self.folder}")
        return {}

    def driver(self, llm: dict, tenant: str | None = None) -> Driver:
        """The driver of a recipe's llm section."""
        own = self.load(tenant or llm.get("tenant"))
        name = str(llm.get("driver") or own.get("driver") or "echo").lower()
        settings = {**self.defaults, **(own.get("settings") or {}), **expand(llm.get("settings") or {})}
        key = json.dumps([name, settings], sort_keys=True, default=str)
        if key not in self._made:
            self._made[key] = create(name, settings)
        return self._made[key]
