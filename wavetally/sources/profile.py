"""Station profiles: one JSON object with required and optional keys, checked on loading."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

REQUIRED = ("station", "frequency_mhz", "primary_city", "stt_prompt", "place_corrections")


@dataclass(frozen=True)
class Profile:
    station: str
    frequency_mhz: float
    primary_city: str
    stt_prompt: str = ""
    place_corrections: dict[str, list[str]] = field(default_factory=dict)
    roundup_cities: tuple[str, ...] = ()
    slot_anchors: dict[str, str] = field(default_factory=dict)
    roundup_leadins: dict[str, str] = field(default_factory=dict)
    term_corrections: dict[str, list[str]] = field(default_factory=dict)
    tz: str | None = None

    @property
    def aliases(self) -> dict[str, str]:
        """Lower-case heard spelling to canonical city."""
        return {heard.lower(): city for city, all_heard in self.place_corrections.items() for heard in all_heard}


def parse_profile(text: str) -> Profile:
    data = json.loads(text)
    if missing := [k for k in REQUIRED if k not in data]:
        raise ValueError(f"profile lacks {', '.join(missing)}")
    known = {k: data[k] for k in Profile.__dataclass_fields__ if k in data}
    known["roundup_cities"] = tuple(known.get("roundup_cities", ()))
    return Profile(**known)


def load_profile(path: str) -> Profile:
    with open(path, encoding="utf-8") as f:
        return parse_profile(f.read())
