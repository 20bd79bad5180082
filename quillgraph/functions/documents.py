"""Per-document helpers of segmentation: small pure functions over one document's lines, run by Spark over many."""

from __future__ import annotations

import re

#: Headings of reference sections.
REFERENCE_HEADINGS = ("references", "bibliography", "works cited", "literature cited", "references cited", "cited references", "reference list", "sources cited")
#: Headings of front and back matter.
FRONT_HEADINGS = ("title page", "contents", "table of contents", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements", "list of tables", "list of figures", "copyright", "figure", "figures", "table", "tables")
BACK_HEADINGS = ("appendix", "appendixes", "list of tables", "list of figures", "table", "tables", "figure", "figures")
PREFACE = "preface"
_ATX = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
_NUMBERED = re.compile(r"^(\[\d+\]|\d{1,3}[.)])\s+\S")
_NAMED = re.compile(r"^[A-Z][\w'’-]+,?\s.*?\b(1[5-9]|20)\d{2}\b")
_CONTINUES = re.compile(r"^((?i:doi\b|https?://|10\.\d{4,9}/)|[a-z(])")
_FIGURE = re.compile(r"^(!\[|fig(ure)?\.?\s*\d|table\s*\d)", re.IGNORECASE)
_YEAR = re.compile(r"\b(1[5-9]|20)\d{2}\b")


def _plain(heading: str) -> str:
    return re.sub(r"[^a-z ]+", "", heading.lower()).strip()


def reference_spans(lines: list[str]) -> list[dict]:
    """Where references stand: under Markdown headings, else under plain ones, else a tail cluster. End lines count in."""
    heads = [(i, len(m[1]), _plain(m[2])) for i, x in enumerate(lines) if (m := _ATX.match(x))]
    spans = []
    for k, (i, level, text) in enumerate(heads):
        if text in REFERENCE_HEADINGS:
            end = next((j for j, l, _ in heads[k + 1 :] if l <= level), len(lines))
            spans.append({"start_line": i + 1, "end_line": end - 1, "method": "markdown_heading", "confidence": 0.98})
    if not spans:
        plain = [i for i, x in enumerate(lines) if _plain(x) in REFERENCE_HEADINGS]
        stops = plain + [i for i, _, _ in heads]
        for i in plain:
            end = min((j for j in stops if j > i), default=len(lines))
            spans.append({"start_line": i + 1, "end_line": end - 1, "method": "plain_heading", "confidence": 0.92})
    if not spans:
        first = max(0, len(lines) - 80)
        lead = [bool(_NUMBERED.match(x) or _NAMED.match(x)) for x in lines]
        for i in range(first, len(lines)):
            if lead[i] and sum(lead[i : i + 12]) >= 3:
                spans.append({"start_line": i, "end_line": len(lines) - 1, "method": "tail_cluster", "confidence": 0.78 if i >= len(lines) - 50 else 0.70})
                break
    return [s for s in spans if s["start_line"] <= s["end_line"]]


def split_entries(lines: list[str]) -> tuple[list[str], list[str]]:
    """(entries, failures): a line that leads opens an entry, others go on with it; each entry once, whatever its case."""
    entries: list[str] = []
    failures: list[str] = []
    for raw in lines:
        line = " ".join(raw.split())
        if not line or _FIGURE.match(line):
            continue
        if _NUMBERED.match(line) or (_NAMED.match(line) and not _CONTINUES.match(line)):
            entries.append(line)
        elif entries:
            entries[-1] = f"{entries[-1]} {line}"
            if not _CONTINUES.match(line):
                failures.append("suspicious_continuation")
        else:
            failures.append("orphan_continuation")
    out, seen = [], set()
    for e in entries:
        for part in _inline(e):
            if len(part) < 12 or not _YEAR.search(part) and not _NUMBERED.match(part):
                failures.append("invalid_reference_text")
            elif part.lower() not in seen:
                seen.add(part.lower())
                out.append(part)
    return out, failures


def _inline(entry: str) -> list[str]:
    """An entry cut where further bracketed numbers start one each."""
    marks = [m.start() for m in re.finditer(r"(?<=\s)\[\d+\]\s", " " + entry)]
    cuts = [max(0, m - 1) for m in marks]
    if len(cuts) < 2 and not (len(cuts) == 1 and cuts[0] > 0):
        return [entry]
    cuts = sorted({0, *cuts})
    return [p for a, b in zip(cuts, [*cuts[1:], len(entry)], strict=True) if (p := entry[a:b].strip())]


def blocks(lines: list[str]) -> list[str]:
    """Semantic blocks: fenced code whole, list and table lines alone, paragraphs up to a blank line."""
    out: list[str] = []
    held: list[str] = []
    fenced = False

    def close() -> None:
        if held:
            out.append("\n".join(held))
            held.clear()

    for line in lines:
        if line.lstrip().startswith("```"):
            if not fenced:
                close()
            held.append(line)
            fenced = not fenced
            if not fenced:
                close()
        elif fenced:
            held.append(line)
        elif not line.strip():
            close()
        elif re.match(r"^\s*([-*+]\s|\d+[.)]\s|\|)", line):
            close()
            out.append(line)
        else:
            held.append(line)
    close()
    return out


def pack(parts: list[str], least: int, target: int, most: int) -> list[str]:
    """Blocks packed to about ``target`` words, none over ``most``; a short last piece joins the one before it if it fits."""
    pieces: list[list[str]] = []
    size = 0
    for part in parts:
        words = part.split()
        chunks = [part] if len(words) <= most else [" ".join(words[i : i + target]) for i in range(0, len(words), target)]
        for c in chunks:
            n = len(c.split())
            if pieces and size + n <= target:
                pieces[-1].append(c)
                size += n
            else:
                pieces.append([c])
                size = n
    texts = ["\n\n".join(p) for p in pieces]
    if len(texts) > 1 and len(texts[-1].split()) < least and len(texts[-1].split()) + len(texts[-2].split()) <= most:
        texts[-2:] = [f"{texts[-2]}\n\n{texts[-1]}"]
    return texts


def markdown_chunks(text: str, least: int = 120, target: int = 220, most: int = 360) -> list[dict]:
    """Chunks by heading: reference sections left out, sections below ``least`` words joined to the one before them."""
    lines = (text or "").split("\n")
    gone = {i for s in reference_spans(lines) if s["method"] != "tail_cluster" for i in range(s["start_line"] - 1, s["end_line"] + 1)}
    found: list[dict] = []
    path: list[str] = []
    start, held = 0, []

    def close(end: int) -> None:
        body = "\n".join(held).strip()
        if body:
            if found and len(body.split()) < least:
                found[-1]["text"] += f"\n\n{body}"
                found[-1]["end"] = end
            else:
                found.append({"text": body, "path": list(path), "start": start, "end": end})
        held.clear()

    for i, line in enumerate(lines):
        if i in gone:
            continue
        m = _ATX.match(line)
        if m and len(m[1]) <= 3:
            close(i - 1)
            del path[len(m[1]) - 1 :]
            path.append(m[2])
            start = i
        else:
            held.append(line)
    close(len(lines) - 1)
    out = []
    for s in found:
        whole = len(s["text"].split()) <= most
        for piece in [s["text"]] if whole else pack(blocks(s["text"].split("\n")), least, target, most):
            out.append({"text": piece, "heading_path": s["path"], "token_count": len(piece.split()), "start_line": s["start"], "end_line": s["end"]})
    return out


_LISTED = re.compile(r"(\.\s?){3,}\s*[\divxlc]+\s*$|\s{2,}\d{1,4}\s*$")
_OUTLINED = re.compile(r"^(chapter\s+)?(\d{1,2}(\.\d{1,2})*|[ivxlc]+)[.:]?\s+\S", re.IGNORECASE)
_WORDS = re.compile(r"[A-Za-z][A-Za-z0-9'&/-]*")


def _is_heading(line: str) -> bool:
    """A Markdown heading, a known one, or a short line in capitals or with an outline number that doesn't end a sentence."""
    if _ATX.match(line):
        return True
    text, words = line.strip(), _WORDS.findall(line)
    if not words or len(words) > 10 or len(text) > 90 or text[-1] in ".,;" or _LISTED.search(line):
        return False
    plain = _plain(text)
    if plain in REFERENCE_HEADINGS or plain in FRONT_HEADINGS or plain == PREFACE or plain.startswith("appendix"):
        return True
    capital = sum(w[0].isupper() for w in words)
    return capital * 2 >= len(words) and (text == text.upper() or bool(_OUTLINED.match(text)) and not _YEAR.search(text))


def sections(lines: list[str], least: int = 24) -> list[dict]:
    """Typed sections that cover all lines: frontmatter, body, references or backmatter_other. End lines count in.

    A heading opens a section; lines of a table of contents are none, and of a running head only the first place counts.
    Sections before the first heading of content are front matter, as is a preface. Front matter in a row is one section;
    a body section below ``least`` lines joins the body section before it.
    """
    if not lines:
        return []
    heads: dict[int, str] = {}
    seen: set[str] = set()
    for i, line in enumerate(lines):
        plain = _plain(line)
        if _is_heading(line) and (plain in REFERENCE_HEADINGS or plain not in seen):
            seen.add(plain)
            heads[i] = plain
    # A tail cluster has no heading of its own.
    refs = {s["start_line"] - (s["method"] != "tail_cluster") for s in reference_spans(lines)}
    listed = [i for i, line in enumerate(lines) if _LISTED.search(line)]
    # A heading of references among the lines of a table of contents is one of its entries.
    refs = {i for i in refs if not any(a < i < b for a, b in zip(listed, listed[1:], strict=False) if b - a <= 3)}
    starts = sorted({0, *heads, *refs})
    back = {i for i, h in heads.items() if i not in refs and (h in BACK_HEADINGS or h.startswith("appendix"))}
    prefaces = [i for i in starts if heads.get(i) == PREFACE]
    content = prefaces or [i for i in starts if i in refs or i not in back and heads.get(i, "") not in FRONT_HEADINGS and not _LISTED.search(lines[i])]
    first = content[0] if content else 0
    out: list[dict] = []
    for start, stop in zip(starts, [*starts[1:], len(lines)], strict=True):
        if start in refs:
            kind = "references"
        elif start < first or heads.get(start) == PREFACE:
            kind = "frontmatter"
        else:
            kind = "backmatter_other" if start in back else "body"
        last = out[-1] if out else None
        if last and last["kind"] == kind and (kind == "frontmatter" or kind == "body" and stop - start < least):
            last["end_line"] = stop - 1
        else:
            heading = " ".join(lines[start].split())[:120] or kind
            out.append({"start_line": start, "end_line": stop - 1, "kind": kind, "heading": heading})
    return out
