"""A linear-time reader of HTML markup: start tags, end tags and text, in order."""

from __future__ import annotations

import html
import re

_TAG = re.compile(r"""<([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<([A-Za-z][^\s/>]*+)([^>]*+)>")
_END = re.compile(r"</([A-Za-z][^\s/>]*+)[^>]*+>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>][^\s=/>]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
#: Elements whose content is not markup; of the last two, character references still count.
RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in ("script", "style", "xmp", "noembed", "noframes", "iframe", "textarea", "title")}


class Markup:
    """Calls handle_starttag(tag, attrs), handle_endtag(tag) and handle_data(text), as far as the page goes.

    Names are in lower case, references replaced. A comment or tag that never ends hides what follows it; a quote that
    never ends is ignored. Every search either moves on by what it has read or ends the page.
    """

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None: ...

    def handle_endtag(self, tag: str) -> None: ...

    def handle_data(self, data: str) -> None: ...

    def handle_empty(self, tag: str) -> bool:
        """Called after a start tag that ends in a slash; whether the element ends there."""
        return False

    def _text(self, s: str) -> None:
        if s:
            self.handle_data(html.unescape(s) if "&" in s else s)

    def feed(self, page: str) -> None:
        at, last = 0, page.rfind(">")
        while True:
            begin = page.find("<", at)
            if begin < 0 or begin > last:
                self._text(page[at:] if begin < 0 or not re.match(r"<[A-Za-z/!?]", page[begin : begin + 2]) else page[at:begin])
                return
            self._text(page[at:begin])
            at = begin
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                if end < 0:
                    return
                at = end + 3
            elif page[at + 1] in "!?":
                at = page.index(">", at) + 1
            elif page[at + 1] == "/" and (m := _END.match(page, at)):
                self.handle_endtag(m[1].lower())
                at = m.end()
            elif m := (_TAG.match(page, at) or _LOOSE.match(page, at)):
                tag = m[1].lower()
                attrs = []
                for a in _ATTRIBUTE.finditer(m[2]):
                    v = a[2]
                    v = None if v is None else v[1:-1] if v[:1] in ("'", '"') and v[-1:] == v[:1] and len(v) > 1 else v
                    attrs.append((a[1].lower(), v if v is None or "&" not in v else html.unescape(v)))
                self.handle_starttag(tag, attrs)
                at = m.end()
                ended = m[2].endswith("/") and self.handle_empty(tag)
                if tag in RAW and not ended:
                    end = RAW[tag].search(page, at)
                    raw = page[at : end.start() if end else len(page)]
                    if raw:
                        self.handle_data(html.unescape(raw) if tag in ("textarea", "title") else raw)
                    if not end:
                        return
                    at = end.start()
            else:
                self.handle_data("<")
                at += 1
