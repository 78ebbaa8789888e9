"""White space and addresses."""

from __future__ import annotations

import re

#: Unicode's White_Space, which differs from what str.isspace accepts. Fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{WHITE}]+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def squeezed(text: str) -> str:
    """Words joined by one blank each."""
    return _RUN.sub(" ", text).strip(WHITE)


def without_white(text: str) -> str:
    return _RUN.sub("", text)


def trimmed(text: str) -> str:
    return text.strip(WHITE)


def is_url(source: str) -> bool:
    return source.startswith(("http://", "https://"))


def absolute(base: str | None, link: str) -> str:
    """A link of a page by the page's address; texts without a web base and full links stay."""
    if not link or base is None or not is_url(base) or link.startswith(("#", "//")) or _SCHEME.match(link):
        return link
    scheme, _, rest = base.partition("://")
    host, slash, path = re.split(r"[?#]", rest)[0].partition("/")
    root = f"{scheme}://{host}"
    path = slash + path
    if link.startswith("?"):
        return root + (path or "/") + link
    target, mark, tail = re.match(r"([^?#]*)([?#]?)(.*)", link, re.S).groups()
    if not target.startswith("/"):
        target = (path.rpartition("/")[0] or "") + "/" + target
    return root + without_dots(target) + mark + tail


def without_dots(path: str) -> str:
    """Path without . and .. segments, never above the root."""
    out: list[str] = []
    parts = path.split("/")
    for k, part in enumerate(parts):
        if part == "..":
            if len(out) > 1:
                out.pop()
        elif part != ".":
            out.append(part)
            continue
        if k == len(parts) - 1:
            out.append("")
    return "/".join(out) or "/"
