"""Problem 3: answers that are no proper answer to their steps.

Each response is held against its steps: nothing said, the steps said back, the
task declined, the text broken off, or another language. A suffix automaton of
the steps' words measures how much of the response is theirs; refusals are found
by an automaton over phrases; stacks of delimiters and the shape of the last
line tell a broken end; votes of frequent words tell the language. The tests
run in that order and the first that holds names the defect.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.lookalike import skeleton, steps_text

#: Words (or Chinese characters) that a copy may put before the steps.
LEAD_WORDS, LEAD_HAN = 7, 12

#: Words that stand for "nothing".
NOTHING = [
    "n/a", "na", "none", "null", "nil", "nothing", "undefined", "nan", "tbd", "todo", "empty", "blank", "void",
    "no output", "no answer", "no response", "no reply", "no result", "no comment", "not available", "not applicable",
    "kein", "keine", "keine antwort", "nichts", "leer", "entfällt", "rien", "aucun", "aucune", "néant", "vide",
    "sans objet", "aucune réponse", "pas de réponse", "nada", "ninguno", "ninguna", "vacío", "sin respuesta",
    "无", "空", "没有", "暂无", "无内容", "无输出", "无回答", "没有输出", "没有回答",
]
_EMPTY = re.compile(
    r"(?:[\s\-–—―_.…·•*~=\[\](){}\"'`:。、]|<[^<>]*>|(?<=```)[a-z]{1,12}(?=\s)|\b(?:"
    + "|".join(re.escape(w) for w in sorted((w for w in NOTHING if w[0].isascii() or w[0].isalpha() and w[0] < "一"), key=len, reverse=True))
    + r")\b|"
    + "|".join(w for w in sorted((w for w in NOTHING if w[0] >= "一"), key=len, reverse=True))
    + r")*\Z",
    re.IGNORECASE,
)

#: Phrases with which a task is declined.
REFUSALS = [
    "can't help with", "cannot help with", "can not help with", "unable to help", "can't assist", "cannot assist", "unable to assist",
    "won't be assisting", "will not be assisting", "won't assist", "won't help", "not able to carry out", "not able to help", "not able to assist",
    "unable to carry out", "can't carry out", "cannot carry out", "can't comply", "cannot comply", "unable to comply", "can't do that", "cannot do that",
    "have to pass on", "must pass on", "must decline", "have to decline", "need to decline", "i decline", "declined under policy", "request declined",
    "isn't possible for me to", "is not possible for me to", "outside what i may do", "outside of what i may do", "not something i may do",
    "rather not take part", "rather not do", "would not be appropriate for me", "wouldn't be appropriate for me", "instructions forbid",
    "against my guidelines", "break our guidelines", "violates our guidelines", "not allowed to help", "not permitted to", "i refuse", "does not handle such requests", "do not handle such requests", "no, that would not be appropriate",
    "can't fulfill", "cannot fulfill", "can't provide that", "cannot provide that", "can't continue with this", "so i will stop here",
    "kann ich nicht helfen", "nicht weiterhelfen", "nicht behilflich sein", "muss ich das ablehnen", "muss ich ablehnen", "lehne ich ab",
    "darf ich so etwas nicht", "darf ich nicht bearbeiten", "kann das nicht bearbeiten", "gegen die richtlinien", "ist mir nicht möglich",
    "je ne peux pas vous aider", "ne peux pas aider", "ne puis vous aider", "je dois décliner", "je dois refuser", "impossible de traiter cela",
    "m'est impossible de", "enfreint les consignes", "je refuse",
    "no puedo ayudar", "no podré ayudar", "no puedo hacer eso", "no me es posible", "debo rechazar", "tengo que rechazar", "debo declinar",
    "incumple las normas", "no puedo cumplir", "me niego",
    "无法协助", "不能协助", "无法帮助", "不能帮助", "无法完成此", "无法完成这个请求", "不能完成这个请求", "不能完成此类任务", "不能完成对", "无法完成对", "恕我拒绝", "我拒绝", "无法满足", "不能提供帮助", "恕难从命",
]

#: Frequent words by language.
FREQUENT = {
    "en": "the and of to is are was were for with that this which because so by from at has have had not it its now then still than as been be will there only once after before into out we you my no one some an",
    "de": "der die das und ist nicht mit ein eine einen einer wurde wird für von bei nach um den dem des auf aus noch nun habe hat ohne zu zum zur wegen jetzt danach zuerst außerdem anschließend blieb gilt lief im am als auch ich nur",
    "fr": "le la les des de du et est un une dans pour avec ne pas que qui sur au aux plus il elle reste été désormais après cela ensuite par cause sans avoir ce cette puis je en sous",
    "es": "el la los las de del y es un una en para con no que se por su al lo ahora después así solo luego primero además según sin otra este esta está más",
}
_VOTES: dict[str, list[str]] = {}
for _lang, _words in FREQUENT.items():
    for _w in _words.split():
        _VOTES.setdefault(_w, []).append(_lang)
#: Letters and endings that tell a language when no frequent word does.
SPELLING = {
    "de": re.compile(r"[äöüß]|\w{3,}(?:ungen|ung|heit|keit|lich|chen|ieren|eren|llen|ssen|hren|mmeln|nnen|chten|ern|eln)\b"),
    "fr": re.compile(r"[èêçàùœ]|\bd'|\bl'|\w{2,}(?:ier|uer|eur|aux|oir|ère)\b"),
    "es": re.compile(r"[ñ¿¡]|\w{2,}(?:ción|ciones|dad|ar|idos|adas)\b"),
    "en": re.compile(r"\w{2,}(?:ing|ly|ght|tch|ck)\b"),
}

_TAG = re.compile(r"</?[A-Za-z_][\w.-]*(?:\s[^<>]*)?>")
_WORD = re.compile(r"[一-鿿㐀-䶿]|[^\W_一-鿿㐀-䶿]+")
_TAG_OR_WORD = re.compile(_TAG.pattern + "|(" + _WORD.pattern + ")")
_HAN = re.compile(r"[一-鿿㐀-䶿]+")
_MARK = re.compile(r"\d{1,3}\Z")


def plain(text: str) -> str:
    """Look-alikes resolved, accents composed."""
    return text if text.isascii() else unicodedata.normalize("NFC", skeleton(text))


class SuffixAutomaton:
    """All stretches of a sequence of words; ``None`` in the sequence separates texts."""

    __slots__ = ("link", "length", "next")

    def __init__(self, words: list[str | None]) -> None:
        self.link, self.length, self.next = [-1], [0], [{}]
        last = 0
        for w in words:
            if w is None:
                last = 0
                continue
            last = self._extend(last, w)

    def _extend(self, last: int, w: str) -> int:
        link, length, nxt = self.link, self.length, self.next
        if w in nxt[last]:  # of a text read before
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w: str) -> int:
        link, length, nxt = self.link, self.length, self.next
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def covered(self, words: list[str], least: int = 2) -> list[bool]:
        """For each word whether it lies in a stretch of the automaton of ``least`` words or more."""
        out = [False] * len(words)
        state, size = 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            if size >= least:
                for k in range(i, i - size, -1):
                    if out[k] and k < i - 1:
                        break
                    out[k] = True
        return out


@lru_cache(maxsize=4096)
def _known(steps: str) -> tuple[frozenset[str], list[list[str]]]:
    """Words of the steps, and the words of each candidate."""
    texts = [_WORD.findall(plain(c).lower()) for s in steps.split("\x02") for c in s.split("\x01")]
    texts = [t for t in texts if t]
    return frozenset(w for t in texts for w in t), texts


@lru_cache(maxsize=4096)
def _prompt(steps: str) -> tuple[SuffixAutomaton, frozenset[str]]:
    """The automaton of the steps' words, and candidates that are a single word."""
    words: list[str | None] = []
    for t in _known(steps)[1]:
        words += [*t, None]
    return SuffixAutomaton(words), frozenset(t[0] for t in _known(steps)[1] if len(t) == 1)


def copied_coverage(text: str, steps: str) -> float:
    """The share of a response's words, behind its lead-in, that lie in stretches of the steps' wording; 0 if there are none.

    The lead-in is what precedes the first such stretch, if it has few words;
    a longer one counts as words that are not copied. List marks and tags are
    no words.
    """
    known, _ = _known(steps)
    if not known:
        return 0.0
    words = [m[1].lower() for m in _TAG_OR_WORD.finditer(text) if m[1]]
    words = [w for w in words if w in known or not _MARK.match(w)]
    if not words:
        return 0.0
    automaton, single = _prompt(steps)
    # a lone word of the lead-in that the steps happen to have is no copy
    inside = [c or w in single for c, w in zip(automaton.covered(words), words, strict=True)]
    if True not in inside:
        return 0.0
    first = inside.index(True)
    lead = words[:first]
    few = sum(w >= "㐀" for w in lead) <= LEAD_HAN and sum(w < "㐀" for w in lead) <= LEAD_WORDS
    return sum(inside) / (len(words) - first if few else len(words))


def is_copied(text: str, steps: str) -> bool:
    """Whether the steps' wording covers all of the response behind its lead-in."""
    known, _ = _known(steps)
    outside, han = 0, 0
    for m in _TAG_OR_WORD.finditer(text):
        w = (m[1] or "").lower()
        if w and w not in known and not _MARK.match(w):
            outside += 1
            han += w >= "㐀"
            # more words that are not the steps' than any lead-in has: no need for the automaton
            if outside - han > LEAD_WORDS or han > LEAD_HAN:
                return False
    return copied_coverage(text, steps) == 1.0


#: Parts from which more phrases of declining are built.
_SELF = ["i", "we", "this assistant", "the assistant"]
_NOT = ["can't", "cannot", "can not", "won't", "will not", "am unable to", "am not able to", "do not", "does not", "don't", "doesn't", "may not", "must not", "am not allowed to", "am not permitted to", "refuse to", "decline to"]
_ACT = ["help", "assist", "carry out", "comply", "handle such", "handle that", "handle this", "handle requests", "do that", "do this", "do such", "take part", "take on", "work on that", "work on this", "work on such", "support such", "process such", "perform such", "accept such", "fulfil", "proceed with that", "proceed with this", "go ahead with"]
#: Cues of a sentence that declines: who speaks, what keeps them from it, what is asked of them. One of each makes a refusal.
_WHO = {
    "en": ["i ", "i'm", "i'd", "i'll", "my ", "me ", "we ", "we're", "our ", "us ", "assistant"],
    "de": ["ich", "mir", "mich", "mein", "wir", "uns", "assistent"],
    "fr": ["je ", "j'", "m'", "me ", "mes ", "mon ", "moi", "nous", "assistant"],
    "es": ["yo ", "me ", "mi ", "mis ", "puedo", "podré", "debo", "tengo", "estoy", "podemos", "nos ", "asistente", "lamento", "rechazo"],
    "zh": ["我", "本助手", "本系统", "恕"],
}
_KEPT = {
    "en": ["can't", "cannot", "can not", "couldn't", "won't", "will not", "wouldn't", "unable", "not able", "not allowed", "not permitted", "not in a position", "not willing", "not going to", "not comfortable", "not let", "not allow",
           "unwilling", "prohibited", "forbidden", "forbid", "barred", "prevent", "restricted from", "off limits", "off-limits", "declin", "refus", "turn down", "turn this down", "have to pass", "must pass", "outside", "beyond", "rather not",
           "against", "not appropriate", "inappropriate", "not possible", "impossible", "isn't possible", "leave it", "out of bounds", "say no", "abstain", "withhold", "opt out", "not something i"],
    "de": ["nicht", "kein", "unmöglich", "ablehn", "lehne", "verweiger", "untersagt", "verboten", "außerhalb", "absehen", "verzichte", "weigere"],
    "fr": ["ne peux pas", "ne puis", "ne pourrai pas", "ne suis pas", "ne peut pas", "impossible", "déclin", "refus", "interdi", "hors de", "pas en mesure", "pas autoris", "contraire", "m'abst", "ne saurais"],
    "es": ["no puedo", "no podré", "no podemos", "no me es", "no estoy", "no tengo permi", "imposible", "rechaz", "declin", "niego", "prohib", "fuera de", "no debo", "contra mis", "abstener", "incapaz"],
    "zh": ["无法", "不能", "不可以", "不便", "拒绝", "不允许", "不被允许", "婉拒", "不会协助", "不得", "超出", "没办法", "不予"],
}
_ASKED = {
    "en": ["help with", "help you", "assist", "comply", "this request", "that request", "such request", "your request", "requests of this", "this task", "that task", "such task", "performing this", "performing that", "perform this", "perform that",
           "do this", "do that", "doing this", "doing that", "this on", "that on", "to this", "to that", "this is something", "that is something", "take part", "taking part", "anything of this kind", "anything like that", "what you describe", "what you ask", "asking for", "my abilities", "my guidelines", "my policy", "our policy", "our guidelines", "my instructions", "what i may do", "what i can do", "fulfil", "provide that", "this one", "that one", "involved", "go along"],
    "de": ["helfen", "hilfe", "behilflich", "bearbeite", "anfrage", "aufgabe", "bitte nach", "so etwas", "dabei", "das tun", "unterstütz", "ausführ", "nachkommen", "wunsch", "möglichkeiten", "richtlinien"],
    "fr": ["aider", "demande", "tâche", "requête", "traiter", "cela", "faire", "assister", "donner suite", "répondre", "accomplir", "consignes", "compétences"],
    "es": ["ayudar", "petición", "solicitud", "tarea", "hacer eso", "hacerlo", "cumplir", "esto", "eso", "atender", "colaborar", "asistir", "normas", "alcance"],
    "zh": ["协助", "帮助", "帮忙", "请求", "任务", "要求", "完成", "处理", "满足", "提供", "能力范围", "从命", "执行"],
}


def _automaton(phrases: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, len(p))
    a.make_automaton()
    return a


def _cues() -> ahocorasick.Automaton:
    """Cues to bits: three a language."""
    bits: dict[str, int] = {}
    for i, lang in enumerate(_WHO):
        for k, table in enumerate((_WHO, _KEPT, _ASKED)):
            for cue in table[lang]:
                bits[cue] = bits.get(cue, 0) | 1 << (3 * i + k)
    a = ahocorasick.Automaton()
    for cue, b in bits.items():
        a.add_word(cue, (len(cue), b))
    a.make_automaton()
    return a


_REFUSAL = _automaton([*REFUSALS, *(f"{x} {y} {z}" for x in _SELF for y in _NOT for z in _ACT)])
_KEEPING = _automaton([cue for table in _KEPT.values() for cue in table])
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
#: Sentences that may follow or precede the one that declines.
_POLITE = 3


_CUES = _cues()
#: Words of a sentence that may decline by its cues alone; a longer one tells of work.
_DECLINING_WORDS = 40
#: What a sentence that declines by its cues doesn't have: names of code, paths, numbers, quotes of tools.
_WORK = re.compile(r"\w[_/]\w|\w\.\w|\d{2}|[`=<>{}|]|::|\w\(")


def declines(sentence: str) -> bool:
    """Whether a sentence in lower case declines: by a known phrase, or by one cue each of who, kept from and asked."""
    if next(_REFUSAL.iter(sentence), None) is not None:
        return True
    seen = 0
    for end, (size, bits) in _CUES.iter(sentence):
        before = sentence[end - size : end - size + 1] if end >= size else ""
        # a cue begins at the begin of a word, but in Chinese
        if sentence[end - size + 1] >= "㐀" or not before.isalpha():
            seen |= bits
    if not any(seen >> 3 * i & 7 == 7 for i in range(len(_WHO))):
        return False
    return len(_WORD.findall(sentence)) <= _DECLINING_WORDS and not _WORK.search(sentence)


def is_refusal(text: str) -> bool:
    """Declines and has hardly anything beside that.

    A few other sentences may stand by it; if no phrase is known and only cues
    tell, these must not tell of work either.
    """
    low = text.lower().replace("’", "'")
    # without a word that keeps anyone from anything no sentence declines by its cues
    if next(_KEEPING.iter(low), None) is None and next(_REFUSAL.iter(low), None) is None:
        return False
    at, work = [], 0
    for s in _SENTENCE.split(low):
        if s.strip():
            if declines(s):
                at.append(s)
            else:
                work += 1
                if work > _POLITE:
                    return False
    if not at:
        return False
    return any(next(_REFUSAL.iter(s), None) is not None for s in at) or not _WORK.search(low)


_FENCE = re.compile(r"^[ \t]*```|```[ \t]*$|(?<=\s)```(?=\s|\w)|```", re.MULTILINE)
_OPEN = re.compile(r"(?:(?<![\w<])(?=<\w)|(?=</))<(/?)([A-Za-z_][\w.-]*)(?:\s[^<>]*)?(/?)>")
_VOID = {"br", "hr", "img", "input", "meta", "link"}
_PARTIAL_TAG = re.compile(r"(?<![\w<=-])</?[A-Za-z_]?[\w.-]*\Z")
_CLOSED = re.compile(r"[.!?。！？…][\"'”’»」』)\]]*\Z")
#: Ends of sentences, log lines, blocks and calls within a line.
_FINISHED = re.compile(r"\[\s*\d{1,3}%\]\s*(?=\S)|={3,}\s+(?=[^\W\d])|```\s+|</\w+>\s+|[.!?]\s+(?=[^\W\d_]*[A-ZÀ-Þ¿])|[。！？]|[)\]]\s+(?=[A-ZÀ-Þ])|[)\]](?=[一-鿿])")
#: A list item that is a name of code, and the begin of a sentence behind it.
_NAMED_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+[A-Za-z_]\w*(?:[_./]\w+)+(?:(?=[一-鿿])|\s+(?=[^\W\d_]*[A-ZÀ-Þ¿])|\s+(?=([^\W\d_]+)\s))")
_LIST = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)]|\[[ xX]?\])\s+\S")
_LOG = re.compile(
    r"\[\s*\d{1,3}%\]\Z|={2,}\Z|::\w+|^\s*(?:\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d)|^\s*\[?(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b|^(?:Output|Exit code|stdout|stderr)\s*:"
    r"|^\s*\[[\d:.,TZ/ -]+\]\s|^\s*(?:\$|>|#)\s|^\s*\d+:\s|^@@|^[+-]"
)
_CODE_END = re.compile(r"[)\]};>]\Z")
#: A JSON value or array at the start of a line; not a check box, a log level or a section.
_VALUE = re.compile(r'^(?:\{|\[)(?=\s*["{\[\]}\d-]|\s*\Z)', re.MULTILINE)
_PAIRS = {")": "(", "]": "[", "}": "{"}


def _unbalanced(block: str) -> bool:
    """Whether the value that begins the block is still open at its end."""
    stack, quoted, escaped = [], False, False
    for c in block:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "([{":
            stack.append(c)
        elif c in ")]}" and stack and stack[-1] == _PAIRS[c]:
            stack.pop()
            if not stack:  # what follows the value is none of it
                return False
    return bool(stack) or quoted


def is_truncated(text: str) -> bool:
    """Breaks off inside a word, sentence, tag, code block or JSON value."""
    text = text.rstrip()
    if text.count("```") % 2:
        return True
    if "<" in text:
        stack: list[str] = []
        outside = text.split("```")[::2] if "```" in text else [text]
        for part in outside:
            for m in _OPEN.finditer(part):
                closing, name, alone = m.groups()
                name = name.lower()
                if alone or name in _VOID:
                    continue
                if not closing:
                    stack.append(name)
                elif name in stack:
                    while stack.pop() != name:
                        pass
        if stack:
            return True
        if _PARTIAL_TAG.search(text):
            return True
    if text.endswith("```"):
        return False
    last = text[text.rfind("\n") + 1 :]
    starts = [m.start() for m in _VALUE.finditer(text)]
    if starts and _unbalanced(text[starts[-1] :]):
        return True
    if _CLOSED.search(last):
        return False
    # what stands behind the last finished thing of the line
    ends = [m.end() for m in _FINISHED.finditer(last)]
    last = last[ends[-1] :] if ends else last
    item = _NAMED_ITEM.match(last)
    if item and (item[1] is None or item[1] in _VOTES):  # in lower case only behind a word that joins sentences
        last = last[item.end() :]
    if _LOG.search(last) or _LIST.match(last):
        return False
    if last.count("(") > last.count(")") or last.count("[") > last.count("]") or last.count("{") > last.count("}"):
        return True
    if _CODE_END.search(last):
        return False
    return bool(re.search(r"[^\W\d_]", last))


_CODE_LINE = re.compile(r"^[ \t]*(?:\[[\d:.,TZ/ -]+\].*|\d{4}-\d\d-\d\d.*|(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b.*|[$>#]\s.*|\d+:\s.*|[+-][ \d].*|.*\[\s*\d{1,3}%\]|.*={3,}.*|Output:.*|Line \d+ now reads .*)$", re.MULTILINE)
_BLOCK = re.compile(r"```.*?(?:```|\Z)|<(\w+)>[^<]*</\1>(?=\s|$)", re.DOTALL)
_THINK = re.compile(r"</?(?:think|answer)>", re.IGNORECASE)
_EDGES = ".,;:!?()[]{}\"'`«»“”„¿¡…"


def votes(text: str) -> tuple[dict[str, float], int]:
    """Votes for each language by frequent words, and the number of alphabetic words.

    Names with dots, digits or signs inside are no words. Chinese votes by its
    number of characters.
    """
    out = dict.fromkeys(("en", "de", "fr", "es", "zh"), 0.0)
    if text.isascii():  # no Chinese, so nobody asks for the number of words
        for token, n in Counter(text.lower().split()).items():
            langs = _VOTES.get(token) or _VOTES.get(token.strip(_EDGES).partition("'")[0])
            if langs:
                for lang in langs:
                    out[lang] += n / len(langs)
        return out, 0
    total = 0
    for token, n in Counter(text.lower().split()).items():
        word = token.strip(_EDGES)
        if not word.isalpha():
            word = word.partition("'")[0]
            if not word.isalpha() or "'" not in token:
                continue
        total += n
        for lang in _VOTES.get(word, ()):
            out[lang] += n / len(_VOTES[word])
    if not text.isascii():
        out["zh"] = float(sum(map(len, _HAN.findall(text))))
    return out, total


def _language(text: str, spelling: bool) -> str | None:
    """The language with clearly the most votes, or None."""
    v, latin = votes(text)
    if v["zh"] >= 2 and v["zh"] >= 0.5 * latin:
        return "zh"
    v["zh"] = 0.0
    if spelling:
        low = text.lower()
        for lang, r in SPELLING.items():
            v[lang] += 0.7 * len(r.findall(low))
    best, second = sorted(v.items(), key=lambda x: -x[1])[:2]
    return best[0] if best[1] >= (0.6 if spelling else 1.5) and best[1] > 1.25 * second[1] else None


def prose(text: str) -> str:
    """The text without code blocks, log lines, tool output and tags."""
    if "<" in text:
        text = _THINK.sub(" ", text)
    if "```" in text or "<" in text:
        text = _BLOCK.sub(" ", text)
    return _CODE_LINE.sub(" ", text)


@lru_cache(maxsize=4096)
def _steps_language(steps: str) -> str | None:
    text = plain(steps.replace("\x01", "\n").replace("\x02", "\n").replace("\x03", "").replace("\x04", ""))
    return _language(re.sub(r"\([^()]*\)", " ", text), True)


def is_foreign(text: str, steps: str) -> bool:
    """Sentences in another language than the steps."""
    asked = _steps_language(steps)
    if asked is None:
        return False
    said = _language(prose(text), False)
    return said is not None and said != asked


def defect(response: str | None, steps: str | None) -> str | None:
    """The defect of a response to steps (as :func:`steps_text` gives them), or None."""
    if response is None:
        return "empty"
    text = plain(response)
    if _EMPTY.match(text):
        return "empty"
    if steps and is_copied(text, steps):
        return "copied"
    if is_refusal(text):
        return "refusal"
    if is_truncated(text):
        return "truncated"
    if steps and is_foreign(text, steps):
        return "language"
    return None


def pair_measures(df: DataFrame, *, id_col: str = "id", response_col: str = "response", steps_col: str = "reference_steps") -> DataFrame:
    """``id, copied_coverage, n_words, defect`` of every row: how much of the response is the steps' wording.

    Coverage is 0 for null or empty responses and steps. One row per input row,
    repeated rows included; a null id stays null, an empty table gives none.
    """
    ready = df.select(F.col(id_col).alias("id"), F.col(response_col).alias("r"), steps_text(F.col(steps_col)).alias("s"))
    schema = T.StructType(
        [ready.schema["id"], T.StructField("copied_coverage", T.DoubleType()), T.StructField("n_words", T.IntegerType()), T.StructField("defect", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, size, found = [], [], []
            for r, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = plain(r or "")
                share.append(copied_coverage(text, s) if s else 0.0)
                size.append(sum(1 for m in _TAG_OR_WORD.finditer(text) if m[1]))
                found.append(defect(r, s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(share, pa.float64()), pa.array(size, pa.int32()), pa.array(found, pa.string())], names=schema.names)

    return ready.mapInArrow(run, schema)


def broken_pairs(
    df: DataFrame, *, id_col: str = "id", response_col: str = "response", steps_col: str = "reference_steps", delivered_col: str = "ingested_at"
) -> DataFrame:
    """``id, defect`` of every row whose response is no proper answer.

    Defects: ``empty, copied, refusal, truncated, language``; the first in this
    order that holds is named. A null response is empty. Null or empty steps
    leave only the defects that need no steps. The latest delivery of an id
    counts (ties: the smallest defect); rows without an id give no row, an
    empty table none. Responses are read whole; only ids, times and defects
    are shuffled.
    """
    ready = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(delivered_col).alias("t"), F.col(response_col).alias("r"), steps_text(F.col(steps_col)).alias("s")
    )
    schema = T.StructType([ready.schema["id"], ready.schema["t"], T.StructField("defect", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect(r, s) for r, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=schema.names)

    made = ready.mapInArrow(run, schema)
    latest = made.groupBy("id").agg(F.max(F.struct("t", "defect")).alias("x"))
    return latest.select("id", F.col("x.defect").alias("defect")).filter("defect is not null")
