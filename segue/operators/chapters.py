"""Chapters of a set: a short list that its user keeps, on the driver.

The tracks of the chapters are a DataFrame of (cluster_id, pos, seq), edited by
``sequencing.move``, ``remove`` and ``append`` with a chapter's id as cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Chapter:
    id: str
    name: str


def default_chapters() -> list[Chapter]:
    """The chapters of a new set."""
    return [Chapter("intro", "Intro"), Chapter("build", "Build"), Chapter("peak", "Peak"), Chapter("outro", "Outro")]


@dataclass
class Chapters:
    """Chapters in order. Ids count up, also past chapters that were removed."""

    chapters: list[Chapter] = field(default_factory=list)
    made: int = 0

    def __len__(self) -> int:
        return len(self.chapters)

    def all(self) -> list[Chapter]:
        return list(self.chapters)

    def get(self, id: str) -> Chapter | None:
        return next((c for c in self.chapters if c.id == id), None)

    def create(self, name: str | None = None) -> Chapter:
        self.made += 1
        self.chapters.append(Chapter(f"chapter-{self.made}", f"Chapter {self.made}" if name is None else name))
        return self.chapters[-1]

    def rename(self, id: str, name: str) -> bool:
        """Whether there is such a chapter."""
        found = self.get(id)
        if found is not None:
            found.name = name
        return found is not None

    def remove(self, id: str) -> bool:
        found = self.get(id)
        self.chapters = [c for c in self.chapters if c is not found]
        return found is not None

    def reorder(self, source: int, target: int) -> bool:
        """Whether both places exist and differ."""
        places = range(len(self.chapters))
        good = source in places and target in places and source != target
        if good:
            self.chapters.insert(target, self.chapters.pop(source))
        return good

    def clear(self) -> None:
        self.chapters, self.made = [], 0
