"""Label spelling, naming, symbols and the rules that act on a confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.functions.text import strip

# Fixed values -----------------------------------------------------------------
NULL_LIKE = ("nan", "none", "")
SENTIMENTS = ("negative", "neutral", "positive")
SPELLING_FIXES = {"Suprise": "Surprise"}
CLASS_WEIGHTS = {"positive": 0.89, "negative": 0.89, "neutral": 1.33}

LABEL_SYMBOLS = {
    "anger": "😠",
    "fear": "😨",
    "joy": "😊",
    "postitive": "❤️",
    "neutral": "😐",
    "sadness": "😢",
    "surprise": "😲",
}
TOP_LABEL_DEFAULT_SYMBOL = "📊"
LABEL_DEFAULT_SYMBOL = "•"

STATUS_SYMBOLS = {
    "NEW": "🟡",
    "LOCKED": "🔒",
    "FETCHED": "✅",
    "PREPROCESSED": "🔧",
    "PREDICTED_MODEL": "🤖",
    "FINALIZED": "📊",
    "RESPONDED": "📨",
    "FAILED": "❌",
}
STATUS_DEFAULT_SYMBOL = "⚪"

# Spellings of the three classes found in evaluation files.
LABEL_SYNONYMS = {
    "positive": "positive",
    "pos": "positive",
    "happy": "positive",
    "joy": "positive",
    "good": "positive",
    "negative": "negative",
    "neg": "negative",
    "sad": "negative",
    "anger": "negative",
    "bad": "negative",
    "neutral": "neutral",
    "neu": "neutral",
    "natural": "neutral",
    "normal": "neutral",
}

REVIEW_BELOW = 0.6
EXPORT_BELOW = 0.7
FALLBACK_BELOW = 0.5
VERDICTS = ((0.85, "EXCELLENT"), (0.75, "GOOD"), (0.65, "ACCEPTABLE"))
WORST_VERDICT = "NEEDS MORE WORK"
# ------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: Mapping) -> Column:
    """A Python mapping as a map literal; for lookup tables of a fixed, small size."""
    return F.create_map(*[F.lit(x) for item in mapping.items() for x in item])


def lookup(c: Column | str, mapping: Mapping, default: Column | str | None = None) -> Column:
    """Value of a literal mapping, or the default where the key is not in it."""
    found = F.try_element_at(literal_map(mapping), _col(c))
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def normalize_label(
    c: Column | str, case: str | None = "lower", fixes: Mapping[str, str] | None = None
) -> Column:
    """Strip, set the case and put known misspellings right.

    ``case`` is ``lower``, ``capitalize`` (first letter of the whole label only)
    or None.
    """
    c = strip(c)
    if case == "lower":
        c = F.lower(c)
    elif case == "capitalize":
        c = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))
    elif case is not None:
        raise ValueError(f"unknown case: {case}")
    return lookup(c, fixes, c) if fixes else c


def is_null_like(c: Column | str) -> Column:
    """True for NULL and for the usual spellings of a missing label."""
    c = _col(c)
    return c.isNull() | F.lower(c).isin(*NULL_LIKE)


def decorate_label(
    c: Column | str,
    symbols: Mapping[str, str] = LABEL_SYMBOLS,
    default: str = LABEL_DEFAULT_SYMBOL,
    fold_case: bool = True,
) -> Column:
    """Symbol shown for a label; labels are found whatever their case."""
    key = F.lower(_col(c)) if fold_case else _col(c)
    return lookup(key, symbols, default)


def decorate_status(c: Column | str) -> Column:
    return decorate_label(c, STATUS_SYMBOLS, STATUS_DEFAULT_SYMBOL, fold_case=False)


def label_name(
    class_id: Column | str, id2label: Column | Mapping[int, str] | None = None
) -> Column:
    """Name of a class id; ids that have none become ``class_<id>``.

    ``id2label`` is a mapping or a column of type ``map<int,string>``, see
    :func:`parse_id2label`.
    """
    class_id = _col(class_id)
    default = F.concat(F.lit("class_"), class_id.cast("string"))
    if id2label is None or (isinstance(id2label, Mapping) and not id2label):
        return default
    names = id2label if isinstance(id2label, Column) else literal_map(id2label)
    return F.coalesce(F.try_element_at(names, class_id), default)


def parse_id2label(json: Column | str) -> Column:
    """The ``id2label`` object of a metadata document as ``map<int,string>``."""
    parsed = F.from_json(_col(json), "id2label map<string,string>")["id2label"]
    return F.transform_keys(parsed, lambda k, _: k.cast("int"))


def is_low_confidence(c: Column | str, threshold: float = REVIEW_BELOW) -> Column:
    """Strictly below the threshold; a missing confidence is not low."""
    return F.coalesce(_col(c) < F.lit(threshold), F.lit(False))


def any_low_confidence(cols: Sequence[Column | str], threshold: float = EXPORT_BELOW) -> Column:
    return reduce(lambda a, b: a | b, (is_low_confidence(c, threshold) for c in cols))


def confidence_fallback(
    label: Column | str,
    confidence: Column | str,
    threshold: float = FALLBACK_BELOW,
    default: str = "neutral",
) -> Column:
    """The label, or the default one where the confidence is below the threshold."""
    return F.when(_col(confidence) < F.lit(threshold), F.lit(default)).otherwise(_col(label))


def accuracy_verdict(accuracy: Column | str) -> Column:
    """Grade of an accuracy."""
    accuracy = _col(accuracy)
    first, *rest = VERDICTS
    verdict = F.when(accuracy >= F.lit(first[0]), F.lit(first[1]))
    for least, name in rest:
        verdict = verdict.when(accuracy >= F.lit(least), F.lit(name))
    return verdict.otherwise(F.when(accuracy.isNotNull(), F.lit(WORST_VERDICT)))
