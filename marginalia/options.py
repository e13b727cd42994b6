"""Options of a recommendation run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RecommendOptions:
    """What a reader configures for one run.

    `days` is the window length counted back from the newest matching paper, `cap` the
    number of newest papers considered (None = all of them), `top_n` applies to each
    section separately, `threshold` is inclusive.
    """

    categories: tuple[str, ...] = field(default_factory=tuple)
    days: int = 1
    cap: int | None = None
    top_n: int = 20
    threshold: float = 0.0


@dataclass(frozen=True)
class ModelOptions:
    """Identity of the encoder whose vectors are stored."""

    model: str
    adapters: bool = False
    base: str = ""
    adapter: str = ""
