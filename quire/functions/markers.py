"""The marker vocabulary of paginated documents: HTML comments, with or without values, and the patterns of other parts.

Patterns keep to what Java and RE2 read alike; ``(?m)`` patterns take ``\\n`` alone as a line end (``d`` in Java).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Marker:
    """``tag`` and, for markers with values, the pattern of each value and the template that writes them."""

    tag: str
    values: tuple[str, ...] = ()
    template: str = ""
    sample: tuple[str, ...] = ()

    @property
    def pattern(self) -> str:
        """The marker with its values captured; a marker without values doesn't match one that has them."""
        return rf"<!--\s*{self.tag}\s*-->" if not self.values else rf"<!--\s*{self.tag}\s+" + ",".join(f"({v})" for v in self.values) + r"\s*-->"

    @property
    def bare(self) -> str:
        """The marker without values, whether or not it should have any."""
        return rf"<!--\s*{self.tag}\s*-->"

    @property
    def around(self) -> str:
        """Three groups: what stands before the values, the values, what stands after."""
        return rf"(<!--\s*{self.tag}\s+)(" + ",".join(self.values) + r")(\s*-->)"

    @property
    def alone(self) -> str:
        """The marker as the sole content of its line."""
        return rf"(?m)^[ \t]*{self.pattern}[ \t]*$"

    def write(self, *values: object) -> str:
        if len(values) != len(self.values):
            raise TypeError(f"{self.tag} takes {len(self.values)} values, not {len(values)}")
        return f"<!-- {self.tag} {self.template.format(*values)} -->" if self.values else f"<!-- {self.tag} -->"

    @property
    def example(self) -> str:
        return self.write(*self.sample)


PAGE_BEGIN = Marker("PDF_PAGE_BEGIN", (r"\d+",), "{0}", ("N",))
PAGE_END = Marker("PDF_PAGE_END", (r"\d+",), "{0}", ("N",))
PAGE_SKIP = Marker("PDF_PAGE_SKIP")
TABLE_CONTINUE = Marker("TABLE_CONTINUE")
IMAGE_BEGIN = Marker("IMAGE_BEGIN")
IMAGE_END = Marker("IMAGE_END")
DESCRIPTION_BEGIN = Marker("IMAGE_AI_GENERATED_DESCRIPTION_BEGIN")
DESCRIPTION_END = Marker("IMAGE_AI_GENERATED_DESCRIPTION_END")
IMAGE_RECT = Marker("IMAGE_RECT", ("[0-9.]+",) * 4, "{0},{1},{2},{3}", ("0.02", "0.15", "0.98", "0.65"))

PAGE_BLOCK = rf"(?s){PAGE_BEGIN.pattern}(.*?)<!--\s*{PAGE_END.tag}\s+\d+\s*-->"
DESCRIPTION = rf"(?s){DESCRIPTION_BEGIN.bare}.*?{DESCRIPTION_END.bare}"
TABLE = r"(?si)<table\b[^>]*>.*?</table>"
HEAD = r"(?si)<thead\b[^>]*>(.*?)</thead>"
BODY = r"(?si)<tbody\b[^>]*>(.*?)</tbody>"
ROW = r"(?si)<tr\b[^>]*>(.*?)</tr>"
CELL = r"(?i)<(?:td|th)\b([^>]*)>"
COLSPAN = r"""(?i)colspan\s*=\s*["']?(\d+)"""
ROWSPAN = r"""(?i)rowspan\s*=\s*["']?(\d+)"""
SPAN = r"(?i)(?:col|row)span\s*="
BINARY = r"<td[^>]*>\s*([01]{4,8})b\s*</td>"
HEADING = r"(?m)^#{1,6}\s+((?:[A-Z]|\d+)(?:\.(?:[A-Z]|\d+))*)\s+"
LINE_HEADING = r"^#{1,6}\s+((?:[A-Z]|\d+)(?:\.(?:[A-Z]|\d+))*)\s+"
BOLD_LINE = r"^\*\*(.+)\*\*$"
IMAGE_NAME = "img_p%03d_%02d.%s"
IMAGE_REFERENCE = r"!\[[^\]]*\]\([^)]*?/img_p\d{3}_\d{2}\.[\w.]+\)"


def reference(kind: str) -> str:
    """A mention of a numbered table or figure."""
    return rf"\b{kind}\s+(\d+|[A-Z]\.\d+)\b"


def definition(kind: str) -> str:
    """A caption that defines it: bold, with a dash after the number."""
    return rf"\*\*{kind}\s+(\d+|[A-Z]\.\d+)\s*[–—-]"


#: Phrases that suggest text was made up, by name, in the order in which they are reported.
SUSPECT = (
    ("summary substitution", "(?i)(?:presented|shown|provided) as (?:summary|brief) (?:references?|overviews?)"),
    ("complexity excuse", "(?si)Due to the complexity.*?(?:these are|they are|see|refer to)"),
    ("subclauses redirect", "(?i)(?:full|complete|detailed) (?:command )?(?:details|specifications?) .*?(?:subclauses|sections?) (?:that follow|below)"),
    ("omission note", "(?i)(?:content|table|data) (?:has been |is |was )?(?:omitted|summarized|abbreviated|condensed)"),
)
