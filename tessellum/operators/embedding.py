"""Vectors for texts: providers behind one small interface, and the column that calls them.

A provider is made on the executor, once a task, and gets batches of at most BATCH texts in
order.  `hashed` needs no network: it counts words into signed buckets, so that texts with
common words are near each other.  `http` speaks the usual JSON protocol of embedding
services, with retries; its transport can be put in from outside, as tests do.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.functions.text import EMBEDDED

BATCH, RETRIES, PAUSE = 100, 3, 0.5
RETRIED = frozenset({429, 500, 502, 503, 504})
MODELS: dict[str, dict[str, int]] = {"openai": {"text-embedding-3-small": 1536, "text-embedding-3-large": 2000}, "hashed": {"words-256": 256}}


@dataclass(frozen=True)
class Config:
    """Which vectors: provider, model and dimensions."""

    provider: str = "openai"
    model: str = "text-embedding-3-large"
    dimensions: int = 2000

    def __post_init__(self) -> None:
        known = MODELS.get(self.provider)
        if known is None:
            raise ValueError(f"no embedding provider {self.provider!r}; there are {', '.join(sorted(MODELS))}")
        if self.model not in known:
            raise ValueError(f"no model {self.model!r} of {self.provider}; there are {', '.join(sorted(known))}")
        if known[self.model] != self.dimensions:
            raise ValueError(f"{self.spec} has {known[self.model]} dimensions, not {self.dimensions}")

    @property
    def spec(self) -> str:
        return f"{self.provider}:{self.model}"

    @classmethod
    def parse(cls, spec: str) -> Config:
        """provider:model, blanks around either ignored."""
        provider, colon, model = (x.strip() for x in spec.partition(":"))
        if not colon or not provider or not model:
            raise ValueError(f"an embedding is written provider:model, not {spec!r}")
        dimensions = MODELS.get(provider, {}).get(model, 0)
        return cls(provider, model, dimensions)


def cut(text: str, most: int = EMBEDDED) -> str:
    """What is sent of a text: that many bytes at most, whole characters."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode(errors="ignore")


@dataclass
class Hashed:
    """Signed word counts in buckets, scaled to length 1; a text without words has zeros."""

    dimensions: int = 256

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> list[float]:
        out = [0.0] * self.dimensions
        for word in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in out))
        return [x / size for x in out] if size else out


class KeyRejected(RuntimeError):
    pass


def _post(url: str, key: str, body: dict) -> tuple[int, str]:
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=60) as reply:  # noqa: S310
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except (TimeoutError, urllib.error.URLError) as e:
        return 503, str(e)


@dataclass
class Http:
    """An embedding service: 429 and 5xx are tried again after 0.5, 1 and 2 seconds, 401 is final."""

    config: Config
    key: str
    url: str
    post: Callable[[str, str, dict], tuple[int, str]] = _post
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        body = {"model": self.config.model, "input": [cut(t) for t in texts], "dimensions": self.config.dimensions}
        status, reply = 0, ""
        for attempt in range(RETRIES + 1):
            if attempt:
                self.sleep(PAUSE * 2 ** (attempt - 1))
            status, reply = self.post(self.url, self.key, body)
            if status not in RETRIED:
                break
        if status == 401:
            raise KeyRejected(reply)
        if not 200 <= status < 300:
            raise RuntimeError(f"the embedding service said {status}: {reply}")
        vectors = [d["embedding"] for d in json.loads(reply)["data"]]
        if len(vectors) != len(texts):
            raise RuntimeError(f"{len(vectors)} vectors came for {len(texts)} texts")
        return vectors


def embedded(rows: DataFrame, provider: Callable[[], Callable[[Sequence[str]], list[list[float]]]], text: str = "chunk", name: str = "embedding") -> DataFrame:
    """rows with the vector of each text; provider() is called on the executor. A null text has a null vector."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = provider()
        for batch in batches:
            texts = batch.to_pylist()
            some = [t for t in texts if t is not None]
            kind = pa.list_(pa.float32())
            got = [pa.array(call(some[i : i + BATCH]), kind) for i in range(0, len(some), BATCH)]
            place = accumulate((t is not None for t in texts), initial=0)
            yield pa.concat_arrays(got or [pa.array([], kind)]).take(pa.array([None if t is None else k for t, k in zip(texts, place, strict=False)], pa.int32()))

    return rows.withColumn(name, run.asNondeterministic()(F.col(text)))


# services and their keys, looked for on the driver

KEY, URL = "OPENAI_API_KEY", "https://api.openai.com/v1/embeddings"


@dataclass
class Service:
    """Makes a provider wherever it is called; refused() remembers its key as one that the service turned down."""

    config: Config
    key: str
    rejected: RejectedKeys
    url: str = URL
    post: Callable[[str, str, dict], tuple[int, str]] = _post

    def __call__(self) -> Http:
        return Http(self.config, self.key, self.url, self.post)

    def refused(self) -> None:
        self.rejected.add(self.key)


def provider(config: Config, root: str | None = None, cache: Path | None = None, url: str = URL, post: Callable = _post, **where: object) -> Callable[[], Callable[[Sequence[str]], list[list[float]]]]:
    """What makes the vectors of a configuration: word counts, or a service with the first key that it has not turned down.

    Vectors of one configuration always come from one provider; without a key there are none.
    """
    if config.provider == "hashed":
        dimensions = config.dimensions
        return lambda: Hashed(dimensions)
    rejected = RejectedKeys(cache or Path.home() / ".cache" / "tessellum" / "rejected-keys")
    return Service(config, rejected.choose(keys(KEY, root, **where)), rejected, url, post)



def _unquoted(value: str) -> str:
    value = value.strip()
    for q in "\"'":
        if len(value) > 1 and value[0] == q == value[-1]:
            return value[1:-1]
    return value


def key_in(text: str, name: str, exported: bool = False) -> str | None:
    """The value of NAME=value, or of export NAME=value, in a file of settings."""
    for line in text.split("\n"):
        line = line.strip()
        if exported:
            if not line.startswith("export"):
                continue
            line = line[len("export") :].lstrip()
        if not line.startswith(name):
            continue
        rest = line[len(name) :].lstrip()
        if rest.startswith("=") and (value := _unquoted(rest[1:])):
            return value
    return None


def _read(path: Path) -> str:
    try:
        return path.read_text()
    except (OSError, UnicodeDecodeError):
        return ""


def keys(name: str, root: str | None = None, environ: dict[str, str] | None = None, home: str | None = None, cwd: str | None = None) -> list[tuple[str, str]]:
    """(key, where) candidates, the best first: environment, .env files upwards of root and cwd, shell profiles."""
    environ = dict(os.environ) if environ is None else environ
    found: list[tuple[str | None, str]] = [(environ.get(name) or None, "environment")]
    for start in filter(None, (root, cwd or os.getcwd())):
        folder = Path(start)
        for place in [folder, *folder.parents][:6]:
            found.append((key_in(_read(place / ".env"), name), ".env"))
    for profile in (".zshrc", ".bashrc", ".zprofile", ".bash_profile"):
        found.append((key_in(_read(Path(home or Path.home()) / profile), name, exported=True), profile))
    first: dict[str, str] = {}
    for value, where in found:
        if value:
            first.setdefault(value, where)
    return list(first.items())


@dataclass
class RejectedKeys:
    """Digests of keys that a service refused, in a file, so that the next run passes over them."""

    path: Path
    known: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.known |= set(_read(self.path).split())

    @staticmethod
    def digest(key: str) -> str:
        return hashlib.sha256(key.encode()).hexdigest()

    def add(self, key: str) -> None:
        if (d := self.digest(key)) not in self.known:
            self.known.add(d)
            self.path.parent.mkdir(parents=True, exist_ok=True)
            with self.path.open("a") as f:
                f.write(d + "\n")

    def choose(self, candidates: list[tuple[str, str]]) -> str:
        """The first key that was not refused; if all were, the file is emptied and the first key tried again."""
        if not candidates:
            raise ValueError("no key for the embedding service was found")
        for key, _ in candidates:
            if self.digest(key) not in self.known:
                return key
        self.known.clear()
        self.path.unlink(missing_ok=True)
        return candidates[0][0]
