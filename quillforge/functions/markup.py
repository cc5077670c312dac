"""An HTML event parser that no input breaks."""

from __future__ import annotations

from html.parser import HTMLParser


class LenientParser(HTMLParser):
    """The standard library's parser, where a marked section of an unknown kind (``<![x``, which that one fails on) is a comment up to its ``>``, as in browsers."""

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def unknown_decl(self, data: str) -> None:
        """Known sections (CDATA, conditional comments) are no text."""
