"""Text of HTML pages, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SKIPPED = frozenset(("script", "style", "noscript"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0
        self.open = False  # whether the last part may go on: the parser splits text at a lone "<"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in SKIPPED
        self.open = False

    def handle_endtag(self, tag: str) -> None:
        self.open = False
        if tag in SKIPPED and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.depth:
            return
        if self.open:
            self.parts[-1] += data
        else:
            self.parts.append(data)
        self.open = True


def page_text(page: str | None) -> str | None:
    """Text nodes joined by line breaks; three or more breaks become two. NULL stays NULL."""
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(parser.parts)).strip()


@F.pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(page_text)
