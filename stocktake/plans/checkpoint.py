"""Resuming a run by segments: what the journal says, and whether it is of the same run."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field, fields

from stocktake.plans.hints import digest


class CheckpointError(ValueError):
    pass


@dataclass(frozen=True)
class Identity:
    """What makes two runs the same listing."""

    bucket: str
    region: str | None = None
    prefix: str = ""
    delimiter: str | None = None
    max_keys: int | None = None
    profile: str | None = None
    addressing_style: str | None = None
    mode: str | None = None
    filter: str | None = None

    def mismatches(self, other: Identity) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name) != getattr(other, f.name)]


@dataclass
class Journal:
    identity: Identity
    total_segments: int
    boundaries_digest: str | None
    completed: list[int] = field(default_factory=list)
    #: What each finished wave of segments has counted, by the name of its folder.
    waves: dict[str, dict[str, int]] = field(default_factory=dict)

    def complete(self, *segments: int) -> None:
        self.completed = sorted({*self.completed, *segments})

    def remaining(self) -> list[int]:
        return sorted(set(range(self.total_segments)) - set(self.completed))

    def save(self, path: str) -> None:
        """Whole or not at all."""
        fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        with os.fdopen(fd, "w") as f:
            json.dump(asdict(self), f)
        os.replace(temp, path)

    @classmethod
    def load(cls, path: str, identity: Identity, boundaries: list[str]) -> Journal:
        """Refused if it is of another run or of other segments; as many segments is not enough."""
        with open(path) as f:
            data = json.load(f)
        journal = cls(Identity(**data["identity"]), data["total_segments"], data.get("boundaries_digest"), sorted(set(data["completed"])), data.get("waves", {}))
        if wrong := journal.identity.mismatches(identity):
            raise CheckpointError("of another run: " + ", ".join(wrong))
        if journal.total_segments != len(boundaries) + 1 or journal.boundaries_digest != digest(boundaries):
            raise CheckpointError("of other segments")
        if any(not 0 <= i < journal.total_segments for i in journal.completed):
            raise CheckpointError("segments out of range")
        return journal


def start(identity: Identity, boundaries: list[str]) -> Journal:
    return Journal(identity, len(boundaries) + 1, digest(boundaries))
