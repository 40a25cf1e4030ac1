"""Tables of the comment store: types, keys and rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# Fixed values -----------------------------------------------------------------
REQUEST_STATUSES = (
    "NEW",
    "LOCKED",
    "FETCHED",
    "PREPROCESSED",
    "PREDICTED_MODEL",
    "FINALIZED",
    "RESPONDED",
    "FAILED",
)
ACTIVE_STATUSES = ("NEW", "LOCKED", "FETCHED")
# ------------------------------------------------------------------------------

_INT, _LONG, _STR, _DBL, _TS = (
    IntegerType(),
    LongType(),
    StringType(),
    DoubleType(),
    TimestampNTZType(),
)


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    on_delete: str  # "cascade" or "set_null"


@dataclass(frozen=True)
class Table:
    """Columns of a table with the rules its rows have to keep."""

    name: str
    schema: StructType
    primary_key: str
    foreign_keys: tuple[ForeignKey, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    max_lengths: dict[str, int] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    bucket_by: str | None = None

    @property
    def not_null(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


def _schema(*cols: tuple) -> StructType:
    return StructType([StructField(name, kind, "required" not in rest) for name, kind, *rest in cols])


_COMMENT = ForeignKey("comment_id", "raw_comments", "comment_id", "cascade")
_COMMENT_KEPT = ForeignKey("comment_id", "raw_comments", "comment_id", "set_null")

REQUESTS = Table(
    "requests",
    _schema(
        ("req_id", _INT, "required"),
        ("user_id", _LONG, "required"),
        ("video_url", _STR, "required"),
        ("status", _STR),
        ("created_at", _TS),
    ),
    primary_key="req_id",
    domains={"status": REQUEST_STATUSES},
)

RAW_COMMENTS = Table(
    "raw_comments",
    _schema(
        ("comment_id", _STR, "required"),
        ("video_id", _STR),
        ("req_id", _INT),
        ("text_display", _STR),
        ("scraped_at", _TS),
    ),
    primary_key="comment_id",
    foreign_keys=(ForeignKey("req_id", "requests", "req_id", "cascade"),),
    max_lengths={"comment_id": 50, "video_id": 20},
    bucket_by="comment_id",
)

PREPROCESSED_COMMENTS = Table(
    "preprocessed_comments",
    _schema(
        ("comment_id", _STR, "required"),
        ("req_id", _INT, "required"),
        ("text_unicode", _STR),
        ("tokens", ArrayType(_STR)),
        ("processed_by", _STR),
        ("processed_at", _TS),
    ),
    primary_key="comment_id",
    foreign_keys=(_COMMENT,),
    max_lengths={"comment_id": 50, "processed_by": 30},
    bucket_by="comment_id",
)

PREDICTIONS = Table(
    "predictions",
    _schema(
        ("id", _INT, "required"),
        ("comment_id", _STR),
        ("req_id", _INT),
        ("model_prediction", _STR),
        ("model_confidence", _DBL),
        ("created_at", _TS),
    ),
    primary_key="id",
    foreign_keys=(_COMMENT,),
    max_lengths={"comment_id": 50, "model_prediction": 20},
    bucket_by="comment_id",
)

FINAL_RESULTS = Table(
    "final_results",
    _schema(
        ("id", _INT, "required"),
        ("comment_id", _STR),
        ("req_id", _INT),
        ("emotion_class", _STR),
        ("source", _STR),
        ("created_at", _TS),
    ),
    primary_key="id",
    foreign_keys=(_COMMENT,),
    max_lengths={"comment_id": 50, "emotion_class": 20, "source": 20},
    bucket_by="comment_id",
)

REVIEW_QUEUE = Table(
    "review_queue",
    _schema(
        ("id", _INT, "required"),
        ("comment_id", _STR),
        ("req_id", _INT),
        ("text", _STR),
        ("model_prediction", _STR),
        ("confidence", _DBL),
        ("created_at", _TS),
        ("status", _STR),
    ),
    primary_key="id",
    foreign_keys=(_COMMENT_KEPT,),
    max_lengths={"comment_id": 50, "model_prediction": 20, "status": 20},
    # Most reads want the pending rows only: partition pruning serves them.
    partition_by=("status",),
    bucket_by="comment_id",
)

LABELED_DATASET = Table(
    "labeled_dataset",
    _schema(
        ("id", _INT, "required"),
        ("comment_id", _STR),
        ("req_id", _INT),
        ("comment_text", _STR),
        ("label", _STR),
        ("predicited", _STR),
        ("labeled_by", _STR),
        ("labeled_at", _TS),
    ),
    primary_key="id",
    foreign_keys=(_COMMENT_KEPT,),
    max_lengths={"comment_id": 50, "label": 20, "predicited": 20, "labeled_by": 50},
)

TRAINING_DATASET = Table(
    "training_dataset",
    _schema(
        ("id", _INT, "required"),
        ("comment_text", _STR, "required"),
        ("label", _STR, "required"),
        ("source", _STR),
        ("source_id", _INT),
        ("confidence", _DBL),
        ("created_at", _TS),
    ),
    primary_key="id",
    max_lengths={"label": 20, "source": 20},
)

TABLES = {
    t.name: t
    for t in (
        REQUESTS,
        RAW_COMMENTS,
        PREPROCESSED_COMMENTS,
        PREDICTIONS,
        FINAL_RESULTS,
        REVIEW_QUEUE,
        LABELED_DATASET,
        TRAINING_DATASET,
    )
}

# One API response page: what lands when the comments of a video are fetched.
COMMENT_PAGE_DDL = (
    "items array<struct<snippet: struct<topLevelComment: "
    "struct<id: string, snippet: struct<textDisplay: string>>>>>, nextPageToken string"
)
