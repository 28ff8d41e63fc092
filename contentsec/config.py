"""Settings of all layers; they become literals of a plan."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from contentsec import patterns


@dataclass(frozen=True)
class Config:
    asymmetry_threshold: float = 0.15
    keywords: tuple[str, ...] = patterns.KEYWORDS
    authority: tuple[str, ...] = patterns.AUTHORITY
    pii: tuple[tuple[str, str], ...] = patterns.PII
    lsb_p_value: float = 0.05
    image_bytes: tuple[int, int] = (1024, 5 << 20)
    images_per_page: int = 10
    pdf_pages: int = 100
    sheets: int = 20
    events: int = 500
    #: By detector; others weigh other_weight.
    weights: tuple[tuple[str, float], ...] = patterns.WEIGHTS
    other_weight: float = patterns.OTHER_WEIGHT
    yellow: float = 0.65
    red: float = 0.35
    quarantine: float = 0.15
    #: A random share by which yellow and red may move, fixed by the seed; 0 for repeatable reports.
    jitter: float = 0.0
    jitter_seed: int = 0
    actions: tuple[str, ...] = patterns.ALLOWED_ACTIONS
    blocked_actions: tuple[str, ...] = patterns.BLOCKED_ACTIONS
    allowed_domains: tuple[str, ...] = ()
    memory_trust: float = 0.4
    memory_quarantine: float = 0.2
    most_hops: int = 5
    #: Entries that a memory keeps, the latest; None for all.
    memory_entries: int | None = None
    secret: str = field(default_factory=lambda: os.environ.get("CONTENTSEC_HMAC_SECRET", "contentsec"))
    require_signatures: bool = False
    url_length: int = 2048
    content_length: int = 10 << 20
    #: Checks that are dead in the usual routing but run here unless turned off.
    route_ics: bool = True
    check_acroform: bool = True

    def thresholds(self) -> tuple[float, float]:
        """Yellow and red, moved by the seeded jitter."""
        import random

        r = random.Random(self.jitter_seed)
        return tuple(t * (1 + r.uniform(-self.jitter, self.jitter)) for t in (self.yellow, self.red))
