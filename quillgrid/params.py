"""Parameters, with the bounds that hold for them."""

from __future__ import annotations

from dataclasses import dataclass

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def as_bool(value: object, default: bool = True) -> bool:
    """Words for yes and no; anything else gives the default."""
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower() if value is not None else ""
    return True if word in _TRUE else False if word in _FALSE else default


def as_list(value: str | list[str] | None) -> list[str]:
    """A comma-separated list, without blanks."""
    items = value.split(",") if isinstance(value, str) else value or []
    return [x.strip() for x in items if x.strip()]


@dataclass(frozen=True)
class Params:
    top_k: int = 4
    candidate_k: int = 12
    keyword_prefilter: bool = True
    evidence_chars: int = 900
    requirement_chars: int = 1200
    reason_chars: int = 120
    row_explanation_chars: int = 256
    review_threshold: float = 0.72
    window_words: int = 320
    overlap_words: int = 60
    #: rules that are broadcast at most; more are joined by their shared key
    broadcast_rules: int = 20_000
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        def put(name: str, value: object) -> None:
            object.__setattr__(self, name, value)

        put("top_k", max(1, int(self.top_k)))
        put("candidate_k", max(self.top_k, int(self.candidate_k)))
        put("keyword_prefilter", as_bool(self.keyword_prefilter))
        put("evidence_chars", max(256, int(self.evidence_chars)))
        put("requirement_chars", max(256, int(self.requirement_chars)))
        put("reason_chars", max(64, int(self.reason_chars)))
        put("row_explanation_chars", max(256, int(self.row_explanation_chars)))
        put("review_threshold", min(0.99, max(0.05, float(self.review_threshold))))
        put("log_level", self.log_level.upper() if self.log_level.upper() in LOG_LEVELS else "INFO")
        if not 0 <= self.overlap_words < self.window_words:
            raise ValueError("overlap_words must be at least 0 and less than window_words")
