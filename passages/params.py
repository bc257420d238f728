"""Settings of the jobs, read from a YAML or JSON file."""

import json
from dataclasses import dataclass, fields
from pathlib import Path


# The names and defaults of the settings.
@dataclass(frozen=True)
class CommonParams:
    env: str
    database: str
    catalog: str | None = None
    # Not among the fixed ones: the format in which a job creates its tables.
    table_format: str = "parquet"


@dataclass(frozen=True, kw_only=True)
class CaptionsParams(CommonParams):
    channel_id: str
    timeout: int = 60
    language: str = "en"


@dataclass(frozen=True, kw_only=True)
class ChunkParams(CommonParams):
    chunk_size: int = 500
    chunk_overlap: int = 50


@dataclass(frozen=True, kw_only=True)
class EmbeddingParams(CommonParams):
    endpoint_name: str


@dataclass(frozen=True, kw_only=True)
class RetrieverParams(CommonParams):
    """``M``, ``efConstruction`` and ``efSearch`` are accepted for configurations that
    tune a graph index; the search here is exact and has no use for them."""

    table_url: str
    M: int = 32
    efConstruction: int = 40
    efSearch: int = 10
    k: int = 5


@dataclass(frozen=True, kw_only=True)
class ChatParams(CommonParams):
    endpoint_name: str
    temperature: float = 0.0
    max_tokens: int = 500


SECTIONS = {
    "video_captions": CaptionsParams,
    "chunk": ChunkParams,
    "embedding": EmbeddingParams,
    "retriever": RetrieverParams,
    "chat": ChatParams,
}


@dataclass(frozen=True)
class Params:
    video_captions: CaptionsParams
    chunk: ChunkParams
    embedding: EmbeddingParams
    retriever: RetrieverParams
    chat: ChatParams


def _value(kind, field, value):
    """The value as the field's type; text is not taken for a number or the reverse."""
    expected = field.type if field.type in (int, float) else str
    if expected is float and type(value) is int:
        value = float(value)
    if type(value) is not expected:
        raise ValueError(f"{kind.__name__}.{field.name}: {value!r} is not {expected.__name__}")
    return value


def _section(kind, values: dict):
    """Known settings of a section; others are ignored, and null stands for the default."""
    known = {
        field.name: _value(kind, field, values[field.name])
        for field in fields(kind)
        if values.get(field.name) is not None
    }
    try:
        return kind(**known)
    except TypeError as error:
        raise ValueError(f"{kind.__name__}: {error}") from None


def parse_params(config: dict) -> Params:
    missing = sorted(SECTIONS.keys() - config.keys())
    if missing:
        raise ValueError(f"missing sections: {', '.join(missing)}")
    return Params(**{name: _section(kind, config[name]) for name, kind in SECTIONS.items()})


def read_params(path: str) -> Params:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return parse_params(json.loads(text))
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("YAML files need PyYAML; use a .json file instead") from error
    return parse_params(yaml.safe_load(text))
