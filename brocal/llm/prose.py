"""Documents cut into prose sentences, sections and addresses; code, menus, footers and markup are set aside."""

from __future__ import annotations

import re
import unicodedata

from brocal.llm.mojibake import _LEADS, _MAPS, _decoded

_MARKUP = re.compile(
    r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|<!--.*?-->|\{\{[^{}]*\}\}|<(div|table|style|script|sup|small)\b[^<>]*>[^<>]*</\1>|</?[A-Za-z][^<>]*>",
    re.S,
)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]|\[([^\[\]]*)\]\([^()\s]*\)")
_ENTITY = re.compile(r"&(?:#?\w{1,8});")
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_HEADING = re.compile(r"^\s*(?:=+\s*(.*?)\s*=+|#{1,6}\s+(.*?))\s*$")
#: How posts of threads and lists begin.
_OPENING = re.compile(r"^\s*(?:(?:[>*•·–-]|\d+[.)])\s+|\[\d\d?:\d\d\]\s*|@\w+:\s*)+")
_CODE = re.compile(
    r"^\s*(?:>>>|\.\.\.\s|\$ |def |class |import |from \w+ import|for \w+ in |return\b|while .*:$|if .*:$|SELECT\b|FROM \w|WHERE\b|GROUP BY\b|INSERT\b|UPDATE\b|[{}\[\]();]+\s*$|[\w.]+\s*[+*/-]?=\s*\S|\{\"|</?\w)"
)
_ADDRESS = re.compile(r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.-]+|#\w+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|es|pt|info|invalid|example)\b(?:/\S*)?")
#: Any address holds one of these.
_HINT = re.compile(r"https?://|www\.|@|#\w|\.(?:com|org|net|es|pt|info|invalid|example)\b")
#: Beginnings of lines that are furniture of a page.
_FURNITURE = re.compile(
    r"^\s*(?:más leído|mais lidas?|most read|secciones|sections|secções|categorías|categories|categorias|contacto|contact|contato|aviso legal|legal notice|todos los derechos|all rights|todos os direitos|©|\(c\)|revisados \||página vecina|etiquetas|tags|compartir|share|suscríbete|subscribe|inicio\b.{0,40}[|>»]|véase también|see also|ver também)",
    re.I,
)
_END = re.compile(r"(?<=[.!?…])[\"»”')\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+")


_FIRST = re.compile("[" + "".join(map(re.escape, sorted(_LEADS["cp1252"]))) + "](?=[" + "".join(re.escape(ch) for ch, b in sorted(_MAPS["cp1252"].items()) if 0x80 <= b <= 0xBF) + "])")


def repaired(text: str) -> str:
    """UTF-8 that was read as Windows-1252 taken back, sequence by sequence, where there is any."""
    if text.isascii():
        return text
    out, done, to = [], 0, _MAPS["cp1252"]
    for m in _FIRST.finditer(text):
        at = m.start()
        if at >= done and (got := _decoded(text, at, to)):
            out += (text[done:at], got[0])
            done = at + got[1]
    return "".join([*out, text[done:]]) if out else text


#: Accented letters by code, and what they are without accents.
_PLAIN = {cp: d for cp in range(0xC0, 0x250) if (d := "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))) != chr(cp)}
_COMBINING = re.compile("[\u0300-\u036f]+")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else _COMBINING.sub("", text.translate(_PLAIN))


class Folded(dict):
    """Lower-case words without accents, kept by word; emptied when there are many."""

    MOST = 500_000

    def __missing__(self, word: str) -> str:
        if len(self) >= self.MOST:
            self.clear()
        got = self[word] = fold(word)
        return got


_folded = Folded()


def raw_words(text: str) -> list[str]:
    """Lower-case words, accents as they are but for combining marks."""
    text = text.lower()
    if not text.isascii():
        text = _COMBINING.sub("", text)
    return _WORD.findall(text)


def words(text: str) -> list[str]:
    """Lower-case words without accents."""
    return [_folded[w] for w in raw_words(text)]


def addresses(text: str) -> list[str]:
    if not _HINT.search(text):
        return []
    # no address reaches over a blank
    return [a for word in text.split() if _HINT.search(word) for a in _ADDRESS.findall(word)]


def _is_code(line: str) -> bool:
    return line.rstrip()[-1:] in (";", "{", "}") or _CODE.match(line) is not None


def parts(text: str) -> tuple[list[str], list[str], list[str]]:
    """Prose sentences, headings, addresses."""
    text = repaired(text)
    found = addresses(text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text or "{{" in text:
        text = _MARKUP.sub(" ", text)
    if "[" in text:
        text = _LINK.sub(lambda m: m[1] or m[2] or "", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    prose, headings = [], []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            continue
        if bare[0] in "=#" and (m := _HEADING.match(line)):
            headings.append(m[1] or m[2] or "")
            continue
        if _is_code(line) or _FURNITURE.match(line) or line.count("|") >= 2:
            continue
        m = _OPENING.match(line)
        if m:
            line = line[m.end() :]
            if _is_code(line) or _FURNITURE.match(line):
                continue
        prose += [s for s in _END.split(line) if s.strip()]
    return prose, headings, found
