"""What a document parser hands over."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Extracted:
    markdown: str = ""
    warnings: list[dict] = field(default_factory=list)
    page_count: int | None = None
    provenance: list[dict] = field(default_factory=list)
    media: list[dict] = field(default_factory=list)

    def warn(self, code: str, message: str, kind: str | None = None, number: int | None = None) -> None:
        self.warnings.append({"code": code, "message": message, "loc_kind": kind, "loc_number": number})
