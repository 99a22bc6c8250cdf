"""Names of a catalog in texts, and replies freed from names, brands and signatures: decided token by token in Arrow batches.

A text is cut into words and single signs.  What goes is found by membership of tokens in word lists, read off from one
place to the next; the names of a whole catalog are one trie over tokens, so a text is read once, however many there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from voxmill.functions.text import PLACEHOLDERS

CUT_OFF, LEAST_WORDS, SIGNED_WORDS, CLOSING_CHARS = 340, 5, 4, 60
APP, CONTACT = PLACEHOLDERS
# Words of greetings, of thanks, and of closings.
GREETINGS = "hi hello hey dear hallo liebe lieber hola olá ola oi bonjour salut ciao merhaba".split()
NO_NAMES = [*GREETINGS, "there", "all", "team"]
THANKED = "feedback review message comment words reseña comentario mensaje opinión comentário avaliação mensagem opinião bewertung nachricht rezension".split()
THANKS = "thank thanks danke gracias obrigad merci".split()
SIGN_OFF_WORDS = "team time equipe equipa equipo équipe grüße saludos abraços cheers regards".split()
CLOSING_HEADS = ["best", "kind", "warm", "many", "with", "beste", "liebe", "freundliche", "viele", "mit freundlichen"]
CLOSINGS = [*"regards wishes thanks best grüße gruß grüßen lg saludos saudações atenciosamente cumprimentos abraços cheers".split(), "take care"]
OWNERS = "dein euer ihr your the das seu sua equipe equipa".split()
GROUPS = "team time equipe support".split()
DESKS = ["kundenservice", "support team"]
# Contacts, pictures, and letters of scripts written without blanks.
_CONTACT = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\bhttps?://\S+|\bwww\.\S+", re.IGNORECASE)
_PICTURES = re.compile("[\U0001f000-\U0001faff\u2600-\u27bf\ufe0f\u200d]")
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]")
_TOKEN = re.compile(r"\{app_name\}|\w+|\W")
_STOPS = ".!?…"


class Names:
    """The names of a catalog as a trie over tokens in lower case."""

    def __init__(self, names: Iterable[str]):
        self.root: dict = {}
        for name in {n.lower(): n for n in names if n}:
            node = self.root
            for token in _TOKEN.findall(name):
                node = node.setdefault(token, {})
            node[None] = len(name)

    def found(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(length, first token, token after the last) of each run of tokens that is a name."""
        out = []
        lower = [t.lower() for t in tokens]
        for start, token in enumerate(lower):
            node, at = self.root.get(token), start + 1
            while node is not None:
                if None in node:
                    out.append((node[None], start, at))
                node, at = node.get(lower[at]) if at < len(lower) else None, at + 1
        return out

    def within(self, text: str) -> bool:
        """Whether a name stands alone in a text."""
        tokens = _TOKEN.findall(text)
        return any(_alone(tokens, start, end) for _, start, end in self.found(tokens))

    def replaced(self, text: str, by: str) -> str:
        """Names that stand alone, and not in a bracket that opens a placeholder, replaced: the longest first."""
        tokens = _TOKEN.findall(text)
        taken: set[int] = set()
        for _, start, end in sorted(self.found(tokens), key=lambda f: (-f[0], f[1])):
            if taken.isdisjoint(range(start, end)) and _alone(tokens, start, end, "{"):
                taken.update(range(start, end))
                tokens[start:end] = [by] + [""] * (end - start - 1)
        return "".join(tokens)


def _alone(tokens: list[str], start: int, end: int, fences: str = "") -> bool:
    """Whether no word, nor any of `fences`, touches a run of tokens; what has been replaced by more than a token is no word."""
    before = next((tokens[k] for k in range(start - 1, -1, -1) if tokens[k]), "")
    after = tokens[end] if end < len(tokens) else ""
    return not (before and (before in fences or _is_word(before)) or after and _is_word(after))


def _is_word(token: str) -> bool:
    return token[0].isalnum() or token[0] == "_"


def _named_to(text: str, at: int) -> list[int]:
    """Where a name of two words, and of one, ends that begins at a place; none if there is none."""
    ends: list[int] = []
    while len(ends) < 2:
        end = at
        while end < len(text) and (_is_word(text[end]) or end > at and text[end] in "'’-"):
            end += 1
        first = text[at : at + 1]
        if end - at < 2 or not (first.isupper() and first <= "Ý"):
            break
        head = _TOKEN.match(text, at)[0].lower()
        if not ends and head in NO_NAMES:
            break
        ends.insert(0, end)
        at = _past(text, end, " \t")
        if at == end:
            break
    return ends


def _past(text: str, at: int, signs: str) -> int:
    while at < len(text) and text[at] in signs:
        at += 1
    return at


def _without_greeted(text: str) -> str:
    """Without the name after a greeting at the start."""
    first = _TOKEN.match(text)
    if not first or first[0].lower() not in GREETINGS:
        return text
    at = first.end() + text.startswith(",", first.end())
    to = _past(text, at, " \t")
    for end in _named_to(text, to) if to > at else []:
        mark = _past(text, end, " \t")
        if text[mark : mark + 1] in (",", "!", ":", "."):
            return first[0] + ("!" if text[mark] == "!" else ",") + text[mark + 1 :]
    return text


def _without_thanked(text: str) -> str:
    """Without names that follow what someone is thanked for and end a clause."""
    out, kept = [], 0
    for word in _TOKEN.finditer(text):
        if word.start() < kept or word[0].lower() not in THANKED:
            continue
        at = word.end() + text.startswith(",", word.end())
        to = _past(text, at, " \t")
        for end in _named_to(text, to) if to > word.end() else []:
            if text[end : end + 1] in (".", "!", ","):
                out.append(text[kept : word.end()])
                kept = end
                break
    return "".join(out) + text[kept:]


def _without_leading(text: str) -> str:
    """Without a name that comes before thanks at the start."""
    for end in _named_to(text, 0):
        to = _past(text, end + 1, " \t")
        if text.startswith(",", end) and to > end + 1 and text[to : to + 8].lower().startswith(tuple(THANKS)):
            return text[to:]
    return text


def _without_signed_lines(text: str) -> str:
    lines = text.splitlines()
    while lines:
        words = lines[-1].split()
        signed = APP in lines[-1] or any(t.lower() in SIGN_OFF_WORDS for t in _TOKEN.findall(lines[-1]))
        if words and not (len(words) <= SIGNED_WORDS and signed):
            break
        lines.pop()
    return "\n".join(lines)


def _words_at(tokens: list[str], at: int, phrases: list[str]) -> int:
    """Where the longest of some phrases ends that stands at a place, or the place itself."""
    best = at
    for phrase in phrases:
        to = at
        for k, word in enumerate(phrase.split()):
            start = to + (k > 0 and to < len(tokens) and tokens[to] == " ")
            if (k and start == to) or start >= len(tokens) or tokens[start] != word:
                break
            to = start + 1
        else:
            best = max(best, to)
    return best


def _only_closing(fragment: str) -> bool:
    """Whether a fragment is nothing but a closing, a signature or both."""
    tokens = _TOKEN.findall(fragment.lower())
    skip = lambda at, signs=" ,:;)!–—-": next((k for k in range(at, len(tokens)) if tokens[k] not in signs), len(tokens))
    head = _words_at(tokens, 0, CLOSING_HEADS)
    at = _words_at(tokens, head + 1, CLOSINGS) if head and head < len(tokens) and tokens[head] == " " else 0
    at = skip(at if at > head + 1 else _words_at(tokens, 0, CLOSINGS))
    desk = _words_at(tokens, at, DESKS)
    owned = skip(_words_at(tokens, at, OWNERS), " ")
    if desk > at:
        at = desk
    elif owned < len(tokens) and tokens[owned] == APP:
        at = owned + 1
        group = skip(at, " -")
        at = max(_words_at(tokens, group, GROUPS), at) if _words_at(tokens, group, GROUPS) > group else at
    return skip(at, " ,:;)!") == len(tokens)


def _without_closing(text: str) -> str:
    """Without closings after the last sentence; white space is single blanks here."""
    while True:
        stop = max(text.rfind(s) for s in _STOPS)
        ends = [k for k in range(max(stop, 0), len(text)) if k == stop or text[k] == ")"]
        rest = next((k for k in ends if text[k + 1 : k + 2] == " " and 1 <= len(text) - k - 2 <= CLOSING_CHARS), None)
        if rest is None or not _only_closing(text[rest + 2 :]):
            return text
        text = text[: rest + 1]


def cleaned(reply: str | None, names: Names) -> str | None:
    text = (reply or "").strip()
    if not text or len(text) >= CUT_OFF and text.endswith(("...", "…")):
        return None
    text = names.replaced(_CONTACT.sub(CONTACT, text), APP) if names.root else _CONTACT.sub(CONTACT, text)
    text = _without_leading(_without_thanked(_without_greeted(_without_signed_lines(text))))
    words = _PICTURES.sub("", text).split()
    # A mark that stands alone joins the word before it.
    text = ""
    for word in words:
        text += word if not text or word[0] in ",.!?:;" else " " + word
    text = _without_closing(text)
    if len(text.split()) < LEAST_WORDS and len(_UNSPACED.findall(text)) < 3 * LEAST_WORDS:
        return None
    return text[0].upper() + text[1:]


def clean_reply(reply: Column, brands: Iterable[str] | None = None) -> Column:
    """A published reply as a reusable one, or null: ones that the store cut off and those under five words are of no use.

    Contacts and brands (longest first) become placeholders; signature lines, names, emoji, stray spaces and closings after
    the last sentence go; the first letter is upper case.
    """
    names = Names(brands or [])
    return F.pandas_udf(lambda said: pd.Series([cleaned(s, names) for s in said], dtype=object), StringType())(reply)


def mentions(text: Column, brands: Iterable[str] | None) -> Column:
    """Whether a text has a name of the catalog; null texts have none."""
    names = Names(brands or [])
    if not names.root:
        return F.lit(False)
    return F.pandas_udf(lambda said: pd.Series([s is not None and names.within(s) for s in said]), BooleanType())(text)
