"""What a URI names: kind of store, file format, and a display name."""

from __future__ import annotations

# URI prefixes of the kinds.
KINDS = {
    "s3": ("s3://", "s3a://"),
    "gcs": ("gs://", "gcs://"),
    "azure_blob": ("az://", "abfs://"),
    "hugging_face": ("hf://", "huggingface://"),
    "delta": ("delta://", "delta+s3://"),
    "iceberg": ("iceberg://",),
    "postgres": ("postgres://", "postgresql://"),
    "mysql": ("mysql://",),
    "http": ("http://", "https://"),
}
# File name endings of the formats.
FORMATS = {"parquet": (".parquet",), "csv": (".csv", ".tsv"), "arrow": (".arrow", ".feather", ".ipc"), "json": (".json", ".jsonl", ".ndjson")}


def detect_kind(uri: str) -> str:
    return next((k for k, starts in KINDS.items() if uri.lower().startswith(starts)), "local_file")


def detect_format(uri: str, kind: str | None = None) -> str:
    """The format by kind, else by file name; Parquet if nothing tells."""
    kind = kind or detect_kind(uri)
    if kind in ("delta", "iceberg"):
        return kind
    if kind in ("postgres", "mysql"):
        return "database"
    path = uri.lower().split("?")[0]
    if ".parquet/" in path:
        return "parquet"
    return next((f for f, ends in FORMATS.items() if path.endswith(ends)), "parquet")


def infer_name(uri: str) -> str:
    return uri.rsplit("/", 1)[-1].split(".")[0]
