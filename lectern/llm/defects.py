"""Broken prompt and response pairs (problem 5).

Method: a multi-label linear classifier over hashed n-grams of the output (its beginning, its end and all of it apart) and of the
error, and over features of the pair (how much of the output stands in the prompt and how much of a prompt's line in the
output, whether it closes what it opens, which languages meet ...).  It is trained on pairs of the input itself made
defective on purpose: truncated, copied, swapped for another language's output, refused, emptied.  Refusals are put together
from a small grammar.  Thresholds are calibrated on held-out pairs, weighted to a share of ``PREVALENCE`` of each defect.  Pairs of the
input that the model finds defective are not sound examples: in the next round they are left out as such, and taken as examples of
the defect where the model is sure.  The classifier alone decides.

Behaviour in corner cases: a null, blank or placeholder output is ``empty`` whatever the error says; a null prompt counts as an
empty one; a call gets at most one defect, the one whose margin is largest (ties in the order of DEFECTS); repeated rows count
once; different rows of one call each count; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.lookalikes import fold
from lectern.llm.reading import language
from lectern.llm.tasks import spread

DEFECTS = ("empty", "refusal", "copy", "truncated", "language")
HASHED = 1 << 15
#: Share of the pairs that is expected to have a given defect, for the thresholds.
PREVALENCE = 0.02
#: What so many of the outputs to one kind of prompt begin with is what the prompt asks for, and stays among the sound examples.
USUAL = 0.05
#: Passes over the examples in the rounds that look for defective pairs, and in the last.
EPOCHS = (6, 6, 30)
FOLDS = 4
#: Defects that show in the words; the others only in what the prompt and the output have to do with each other.
BY_WORDS = np.array([[1], [1], [0], [1], [0]], dtype=np.float32)
#: The parts of synthetic refusals in English.
OPENERS = ("", "", "", "I'm sorry, but ", "Sorry, ", "Sorry, no. ", "Unfortunately ", "Regrettably, ", "Apologies, but ", "I apologize, but ", "Thank you for your question. ", "As an AI language model, ", "As a language model ", "As an assistant ")
REFUSING = (
    "I can't {do}", "I cannot {do}", "I can not {do}", "I am unable to {do}", "I'm not able to {do}", "I won't be able to {do}", "I will not {do}", "I am not allowed to {do}", "I am not permitted to {do}",
    "I must decline to {do}", "I have to refuse to {do}", "I would rather not {do}", "I don't feel comfortable if I {do}", "my guidelines do not permit me to {do}", "my rules do not allow me to {do}",
    "it would not be appropriate for me to {do}", "it is not possible for me to {do}", "this assistant may not {do}", "I have to pass on this", "this is outside of what I am allowed to do", "this is not something I can do",
    "that goes against my policy", "no answer can be given to this", "providing this is not possible for me", "I must decline this request", "your request can't be fulfilled by this assistant",
)
DOING = (
    "help with this", "help with that request", "assist with this", "answer this", "answer this question", "write this", "write about {topic}", "produce this text", "provide such content", "comment on {topic}", "discuss {topic}",
    "explain this topic", "continue with this task", "go on with this", "fulfil this request", "complete this request", "create this", "talk about {topic}", "give an answer",
)
ENDINGS = ("", "", "", "", " for safety reasons", " at this time", " as it is outside my guidelines", ", and I would rather stop here")
OFFERS = ("", "", "", "", " Please ask someone else.", " If you like, I can talk about another subject.", " Is there anything else I can do for you?", " Please consult an expert instead.")
#: Refusals in other languages.
REFUSALS = {
    "de": ("Es tut mir leid, aber dabei kann ich nicht helfen.", "Diese Anfrage muss ich leider ablehnen.", "Das kann ich leider nicht beantworten.", "Ich darf diesen Text nicht schreiben."),
    "fr": ("Je suis désolé, je ne peux pas répondre à cette demande.", "Je ne peux pas vous aider.", "Désolé, je dois refuser.", "Il m'est impossible de rédiger ce texte."),
    "es": ("Lo siento, no puedo ayudar con eso.", "No puedo responder a esta solicitud.", "Lo lamento, debo rechazar esta petición.", "No me está permitido escribir este texto."),
    "ru": ("Извините, я не могу помочь с этим запросом.", "К сожалению, я не могу ответить.", "Я вынужден отказаться от этого запроса."),
    "el": ("Λυπάμαι, δεν μπορώ να βοηθήσω με αυτό.", "Δεν μπορώ να απαντήσω σε αυτό το αίτημα."),
    "ja": ("申し訳ありませんが、お答えできません。", "申し訳ありませんが、そのご依頼にはお応えできません。", "その文章は書くことができません。"),
    "zh": ("抱歉，我无法回答这个请求。", "对不起，我不能帮助处理这个请求。", "很遗憾，我不能写这段文字。"),
    "ar": ("عذرا، لا يمكنني المساعدة في هذا الطلب.", "آسف، لا أستطيع الإجابة عن هذا."),
    "hi": ("क्षमा करें, मैं इसमें मदद नहीं कर सकता।", "मैं इस अनुरोध का उत्तर नहीं दे सकता।"),
    "th": ("ขออภัย ฉันไม่สามารถช่วยเรื่องนี้ได้", "ขอโทษ ฉันตอบคำขอนี้ไม่ได้"),
}
#: Plain sentences that seed outputs in another language, as the pairs may all be in one.
NEUTRAL = {
    "en": "The water flows through the pipe and the pressure falls with the height.", "de": "Das Wasser fließt durch das Rohr und der Druck sinkt mit der Höhe.",
    "fr": "L'eau coule dans le tuyau et la pression baisse avec la hauteur.", "es": "El agua corre por el tubo y la presión baja con la altura.",
    "ru": "Вода течёт по трубе, и давление падает с высотой.", "el": "Το νερό κυλά στον σωλήνα και η πίεση πέφτει με το ύψος.", "ja": "水は管の中を流れ、圧力は高さとともに下がる。",
    "zh": "水流过管子，压力随高度下降。", "ar": "يجري الماء في الأنبوب ويقل الضغط مع الارتفاع.", "hi": "पानी नली में बहता है और ऊँचाई के साथ दबाव घटता है।", "th": "น้ำไหลผ่านท่อและความดันลดลงตามความสูง",
}
#: Notes that a text does not cover a question, which are answers.
NOTES = ("The passages do not say {topic}, so this cannot be answered from them.", "This is not covered by the text.", "The paper does not mention {topic}.", "There is not enough information in the passages to answer this.")
#: Outputs that hold no answer, and what may stand around them.
BLANKS = ("", " ", "\n", "...", "-", "null", "none", "nil", "n/a", "empty", "undefined", "no output", "no answer", "no response", "***", "\u200b", "_", "todo", "tbd")
AROUND = ("{}", "{}", "{}", "[{}]", "<{}>", "({})", '"{}"', "`{}`", "```\n{}\n```", "{}.", "Answer: {}", "Response: {}", "Output: {}")
#: Errors of an output that was cut off.
CUT_OFF = ("finish reason: length", "maximum number of tokens reached", "output limit reached", "response was truncated", "stopped early", "stream closed before the end of the answer", "incomplete output")
#: Names of languages, in several languages.
LANGUAGES = {
    "en": "english englisch anglais inglés inglese inglês английский английском 英語 英语", "de": "german deutsch allemand alemán tedesco alemão немецкий немецком ドイツ語 德语",
    "fr": "french französisch français francés francese francês французский французском フランス語 法语", "es": "spanish spanisch espagnol español spagnolo espanhol испанский испанском スペイン語 西班牙语",
    "ru": "russian russisch russe ruso russo русский русском ロシア語 俄语", "zh": "chinese chinesisch chinois chino cinese chinês китайский китайском 中国語 中文 汉语", "ja": "japanese japanisch japonais japonés giapponese japonês японский японском 日本語 日语",
    "ar": "arabic arabisch arabe árabe arabo арабский арабском アラビア語 阿拉伯语 العربية", "el": "greek griechisch grec griego greco grego греческий греческом ギリシャ語 希腊语 ελληνικά", "hi": "hindi хинди ヒンディー語 印地语 हिन्दी हिंदी",
    "th": "thai thailändisch thaï tailandés тайский тайском タイ語 泰语 ไทย", "it": "italian italienisch italien italiano итальянский итальянском イタリア語 意大利语", "pt": "portuguese portugiesisch portugais portugués portoghese português португальский португальском ポルトガル語 葡萄牙语",
    "nl": "dutch niederländisch néerlandais neerlandés olandese holandês nederlands нидерландский нидерландском オランダ語 荷兰语", "ko": "korean koreanisch coréen coreano корейский корейском 韓国語 韩语 한국어",
}
_NAMED = {name: k for k, names in LANGUAGES.items() for name in names.split()}
_BEFORE = r"\b(?:in|into|auf|en|ins|em|на|in het)\s+"
_ASKED = re.compile(
    _BEFORE + "(" + "|".join(n for n in _NAMED if "a" <= n[0] <= "ÿ" or "а" <= n[0] <= "я") + r")\b|(" + "|".join(n for n in _NAMED if not ("a" <= n[0] <= "ÿ" or "а" <= n[0] <= "я")) + ")",
    re.IGNORECASE,
)
_SCRIPTS = (("ja", "[぀-ヿ]"), ("ko", "[가-힯]"), ("zh", "[一-鿿]"), ("ru", "[Ѐ-ӿ]"), ("el", "[Ͱ-Ͽ]"), ("ar", "[؀-ۿ]"), ("hi", "[ऀ-ॿ]"), ("th", "[฀-๿]"))
_SCRIPTS = tuple((k, re.compile(v)) for k, v in _SCRIPTS)
_WORD = re.compile(r"[぀-ヿ一-鿿฀-๿]|[^\W_]+")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_ITEM = re.compile(r"\s*(?:[-•*]|\d{1,3}[.)])(?:\s|$)")
_BARE = re.compile(r"\n\s*(?:[-•*]|\d{1,3}[.)]?)\s*$")
_STOP = re.compile(r"[.!?।؟;](?:\s|$)|[。！？]")
_FIRST = re.compile(r"[.!?।؟](?=\s|$)|[。！？\n]")
_STRINGS = re.compile(r'"((?:[^"\\]|\\.)*)(?:"(\s*:)?|$)')
_KEYS = re.compile(r'"([^"\\]*)"\s*:')
_LIMIT = re.compile(r"length|limit reached|budget|cut off|truncat|stopped early|incomplete|partial|max\w*.{0,12}tokens|before the (?:answer|end)", re.IGNORECASE)
_TERMINAL = tuple(".!?…。！？।॥؟;\"”»’')]}）」』`")

DENSE = (
    "bias", "words_0", "words_1", "words_2", "words_few", "json_broken", "json_whole", "json_one_key", "json_many_keys", "fence_open", "fence_whole", "terminal", "listed", "item_bare", "prose", "prose_open",
    "unbalanced", "ends_joining", "limit_error", "other_error", "repeats", "repeats_most", "line_covered", "line_mostly", "first_covered", "terms", "language_differs", "language_same", "short",
)


def language_of(text: str) -> str | None:
    """The language of a text: by script, and by function words for the Latin one."""
    if not text.isascii():
        latin = len(_LATIN.findall(text))
        best, most = None, 0
        for k, pattern in _SCRIPTS:
            n = len(pattern.findall(text))
            if k == "ja" and n:
                n += len(re.findall("[一-鿿]", text))
            if n > most:
                best, most = k, n
        if most and most * (2 if best in ("zh", "ja", "ko", "th") else 1) >= latin:
            return best
    return language(text)


def asked_language(prompt: str) -> str | None:
    """The language that a prompt asks for, else its own."""
    named = [a or b for a, b in _ASKED.findall(prompt)]
    return _NAMED[named[-1].lower()] if named else language_of(prompt)


def structured(t: str) -> bool:
    """Whether a stripped output begins as JSON does."""
    return t[:1] == "{" or t[:1] == "[" and t[1:].lstrip()[:1] in ('{', '[', '"', "]", *"-0123456789")


def answer_text(output: str) -> str:
    """What an output says: the string values of JSON, else the output."""
    t = output.strip()
    return " ".join(x for x, key in _STRINGS.findall(t) if not key) if structured(t) else t


def _parts(prompt: str) -> list[list[str]]:
    """The parts of a prompt that an output may repeat: all of it, its lines, and what follows a colon."""
    lines = [x for x in prompt.split("\n") if x.strip()]
    parts = [prompt, *lines] if len(lines) > 1 else [prompt]
    parts += [x.partition(c)[2] for x in parts for c in (":", "：") if c in x]
    return [w for x in parts if len(w := _WORD.findall(x.lower())) > 3]


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def features(prompt: str, output: str, error: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense features, and places and values of the hashed n-grams."""
    prompt, output = fold(prompt), fold(output)
    t = output.strip()
    said = answer_text(t)
    words = _WORD.findall(t.lower())
    value = _WORD.findall(said.lower())
    f = dict.fromkeys(DENSE, 0.0)
    f["bias"] = 1
    n = len(value)
    f["words_0"], f["words_1"], f["words_2"], f["words_few"] = n == 0, n == 1, n == 2, 3 <= n < 8
    f["short"] = len(words) < 4
    keys: list[str] = []
    if structured(t):
        keys = _KEYS.findall(t)
        f["json_one_key"], f["json_many_keys"] = len(keys) == 1, len(keys) > 2
        try:
            json.loads(t)
            f["json_whole"] = 1
        except ValueError:
            f["json_broken"] = 1
    elif t.startswith("```"):
        f["fence_open"] = t.count("```") % 2
        f["fence_whole"] = 1 - f["fence_open"]
    else:
        f["terminal"] = t.endswith(_TERMINAL)
        thai = len(re.findall("[฀-๿]", t)) > 3
        lines = [x for x in t.split("\n") if x.strip()]
        items = sum(bool(_ITEM.match(x)) for x in lines)
        f["listed"] = items >= 0.6 * len(lines) and items > 0
        f["item_bare"] = bool(_BARE.search(t))
        f["prose"] = bool(not f["listed"] and _STOP.search(t))
        f["prose_open"] = bool(f["prose"] and not f["terminal"] and not thai)
        f["unbalanced"] = t.count("(") != t.count(")") or t.count("«") != t.count("»") or t.count("“") > t.count("”") or t.count("「") != t.count("」") or t.count("`") % 2 == 1
        f["ends_joining"] = t.endswith((",", "-", "，", "、", ":", "(", "—", "،"))
    f["limit_error"] = bool(_LIMIT.search(error))
    f["other_error"] = bool(error) and not f["limit_error"]
    if n > 3 and (parts := _parts(prompt)):
        own = _pairs(value)
        there = _pairs(parts[0])
        f["repeats"] = len(own & there) / len(own)
        f["repeats_most"] = f["repeats"] > 0.8
        f["line_covered"] = max(len(own & p) / len(p) * min(1.0, len(p) / max(4, len(own))) for p in map(_pairs, parts))
        f["line_mostly"] = f["line_covered"] > 0.7
        first = _pairs(_WORD.findall(prompt.strip().partition("\n")[0].lower()))
        f["first_covered"] = len(own & first) / len(first) if first else 0.0
        f["terms"] = f["repeats"] * (1 - f["line_covered"])
    want = asked_language(prompt)
    have = None if t.startswith("```") else language_of(said) if len(said) >= 12 and n > 3 else None
    f["language_differs"] = bool(want and have and want != have)
    f["language_same"] = bool(want and have and want == have)
    cut = _FIRST.search(said, 12)
    first = _WORD.findall(said[: cut.end()].lower() if cut else said.lower())[:40]
    end = words[-3:]
    groups = (
        [f"s:{x}" for x in first] + [f"s:{x} {y}" for x, y in zip(first, first[1:])] + [f"3:{x} {y} {z}" for x, y, z in zip(first, first[1:], first[2:])],
        [f"w:{x}" for x in value] + [f"w:{x} {y}" for x, y in zip(value, value[1:])],
        [f"e:{' '.join(end[-k:])}" for k in (1, 2, 3) if len(end) >= k] + [f"c:{t[-k:]}" for k in (1, 2, 3, 4)] + [f"t:{t[:1]}{t[-1:]}"],
        [f"x:{x}" for x in _WORD.findall(error.lower())],
        [f"k:{x}" for x in keys] + [f"k:{len(keys)}"],
    )
    places: list[int] = []
    values: list[float] = []
    for g in groups:
        at = {zlib.crc32(x.encode()) % HASHED for x in set(g)}
        places += at
        values += [max(1, len(at)) ** -0.5] * len(at)
    return np.array([float(f[k]) for k in DENSE], dtype=np.float32), np.array(places, dtype=np.int64), np.array(values, dtype=np.float32)


class Batch:
    """Features of many pairs as arrays."""

    def __init__(self, xs: list) -> None:
        self.dense = np.stack([x[0] for x in xs])
        self.size = np.array([len(x[1]) for x in xs])
        self.places = np.concatenate([x[1] for x in xs])
        self.values = np.concatenate([x[2] for x in xs])
        self.start = np.cumsum(self.size) - self.size


class Classifier:
    """One-against-rest logistic regression for each defect, with thresholds."""

    def __init__(self) -> None:
        self.dense = np.zeros((len(DEFECTS), len(DENSE)), dtype=np.float32)
        self.hashed = np.zeros((len(DEFECTS), HASHED), dtype=np.float32)
        self.threshold = np.zeros(len(DEFECTS), dtype=np.float32)

    def scores(self, b: Batch) -> np.ndarray:
        """A row for each defect, a column for each pair."""
        return self.dense @ b.dense.T + np.add.reduceat(self.hashed[:, b.places] * b.values, b.start, axis=1)

    def fit(self, xs: list, labels: np.ndarray, epochs: int = 15, size: int = 512, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> None:
        """labels: index of the defect, -1 for none."""
        order = np.random.default_rng(seed).permutation(len(xs))
        batches = [(Batch([xs[i] for i in some]), (labels[some][None, :] == np.arange(len(DEFECTS))[:, None]).astype(np.float32)) for some in np.array_split(order, max(1, len(xs) // size))]
        gd, gh = np.full_like(self.dense, 1e-2), np.full_like(self.hashed, 1e-2)
        for _ in range(epochs):
            for b, y in batches:
                g = (1 / (1 + np.exp(-np.clip(self.scores(b), -30, 30))) - y) / np.sqrt(y.shape[1])
                step = g @ b.dense
                gd += step * step
                self.dense -= rate * step / np.sqrt(gd)
                for k in np.flatnonzero(BY_WORDS):
                    step = np.bincount(b.places, weights=b.values * np.repeat(g[k], b.size), minlength=HASHED).astype(np.float32)
                    gh[k] += step * step
                    self.hashed[k] -= rate * step / np.sqrt(gh[k]) + decay * self.hashed[k]

    def calibrate(self, xs: list, labels: np.ndarray) -> None:
        """For each defect the threshold with the best F1 on held-out pairs (of those within 0.03, the nearest to even odds)."""
        if not len(xs):
            return
        s = self.scores(Batch(xs))
        grid = np.linspace(-4, 4, 81)
        for k in range(len(DEFECTS)):
            own, sound, other = labels == k, labels == -1, (labels != k) & (labels != -1)
            if not own.any() or not sound.any():
                continue
            # a defect is rare among the pairs, the others are as rare
            weight = own * (PREVALENCE / own.sum()) + sound * (1.0 / sound.sum()) + other * (PREVALENCE * (len(DEFECTS) - 1) / max(1, other.sum()))
            f1 = []
            for t in grid:
                hit = s[k] > t
                f1.append(2 * weight[hit & own].sum() / (weight[hit].sum() + PREVALENCE))
            best = [t for t, v in zip(grid, f1) if v >= max(f1) - 0.03]
            self.threshold[k] = min(best, key=abs)

    def margins(self, xs: list) -> np.ndarray:
        return self.scores(Batch(xs)) - self.threshold[:, None] if xs else np.empty((len(DEFECTS), 0))

    def defects(self, xs: list) -> list[str | None]:
        m = self.margins(xs)
        return [DEFECTS[k] if m[k, i] > 0 else None for i, k in enumerate(m.argmax(axis=0))] if xs else []


class Spoiler:
    """Makes sound pairs defective."""

    def __init__(self, rows: list[tuple[str, str, str]], seed: int) -> None:
        self.r = np.random.default_rng(seed)
        self.by: dict[str, list[str]] = {}
        self.tails: list[str] = []
        for _, o, _ in rows:
            if structured(o.strip()) or o.strip().startswith("```") or len(o) < 40:
                continue
            if lang := language_of(o):
                self.by.setdefault(lang, []).append(o)
                sentence = o[: m.end()] if (m := _FIRST.search(o, 12)) else o
                self.tails.append(sentence.strip())
        for lang, sentence in NEUTRAL.items():
            self.by.setdefault(lang, []).append(f"{sentence} {sentence}")
        self.tails = self.tails or [NEUTRAL["en"]]
        self.cut_off = sorted({e for _, _, e in rows if _LIMIT.search(e)} | set(CUT_OFF))

    def pick(self, some):
        return some[int(self.r.integers(len(some)))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def refusal(self, prompt: str, want: str | None) -> str:
        if want in REFUSALS and self.chance(0.7):
            return self.pick(REFUSALS[want])
        words = prompt.split()
        at = int(self.r.integers(max(1, len(words) - 2)))
        topic = " ".join(words[at : at + 2]).strip(".,:?!\"'") or "this"
        t = self.pick(OPENERS) + self.pick(REFUSING).format(do=self.pick(DOING).format(topic=topic)) + self.pick(ENDINGS)
        return t[0].upper() + t[1:] + "." + self.pick(OFFERS)

    def loud(self, t: str) -> str:
        """The same in another case, spacing or apostrophe."""
        how = self.r.random()
        return t.upper() if how < 0.06 else t.lower() if how < 0.1 else "  " + "  ".join(t.split(" ")) + "\n" if how < 0.14 else t.replace("'", "’") if how < 0.25 else t

    def wrapped(self, o: str, t: str) -> str:
        """As the only value of JSON where the output is JSON."""
        keys = _KEYS.findall(o) if structured(o.strip()) else []
        return json.dumps({self.pick(keys): t}, ensure_ascii=False) if keys and self.chance(0.6) else t

    def copy(self, p: str) -> str:
        lines = [x for x in (p, p, p.strip().split("\n")[0], p.strip().split("\n")[-1], *(x.partition(":")[2] for x in p.split("\n") if ":" in x)) if len(x.strip()) > 12]
        c = self.pick(lines).strip() if lines else p.strip()
        if self.chance(0.25):
            c = self.pick(("> ", "Question: ", "You asked: ", "Q: ", "Task: ", "Request: ", '"')) + c
        if self.chance(0.1):
            c = f"{c.rstrip('.')}\n{c}"
        words = c.split(" ")
        if len(words) > 5 and self.chance(0.2):
            at = int(self.r.integers(1, len(words) - 2))
            del words[at : at + int(self.r.integers(1, 3))]
            c = " ".join(words)
        return c

    def truncated(self, o: str, e: str) -> tuple[str, str]:
        t = o[: max(2, int(len(o) * self.r.uniform(0.1, 0.98)))]
        if self.chance(0.25):
            # a cut between sentences or items is only to be seen by the error
            ends = [m.end() for m in _FIRST.finditer(o)]
            return (o[: self.pick(ends)] if ends else t), self.pick(self.cut_off)
        free = not structured(t.strip()) and not t.strip().startswith("```")
        while t and free and t.rstrip().endswith(_TERMINAL):
            t = t.rstrip()[:-1]
        return t, self.pick(self.cut_off) if self.chance(0.3) else e

    def __call__(self, row: tuple[str, str, str]) -> list[tuple[tuple[str, str, str], int]]:
        """The pair as it is (-1) and made defective in some ways."""
        p, o, e = row
        out = [(row, -1)]
        want = asked_language(p)
        no = {d: i for i, d in enumerate(DEFECTS)}
        free = not structured(o.strip()) and not o.strip().startswith("```")
        if len(o) > 20:
            for _ in range(2):
                t, error = self.truncated(o, e)
                if t.strip() and t.strip() != o.strip():
                    out.append(((p, t, error), no["truncated"]))
        if self.chance(0.6):
            t = self.refusal(p, want)
            if self.chance(0.3):
                t = f"{t} {self.pick(self.tails)}"
            out.append(((p, self.wrapped(o, self.loud(t)), e), no["refusal"]))
        if self.chance(0.5):
            out.append(((p, self.wrapped(o, self.loud(self.copy(p))), e), no["copy"]))
        if self.chance(0.3):
            t = self.pick(AROUND).format(self.pick(BLANKS))
            if self.chance(0.4):
                t = json.dumps({self.pick(_KEYS.findall(o) or ["answer"]): self.pick((None, "", [], {}))} if self.chance(0.7) else self.pick(([], {}, "", None)))
            out.append(((p, t, e), no["empty"]))
        others = sorted(k for k in self.by if k != want)
        if want and others and free and self.chance(0.5):
            out.append(((p, self.pick(self.by[self.pick(others)]), e), no["language"]))
        # sound ones that look defective: lists in another order and shorter, quoted refusals, notes that a text lacks the answer
        lines = o.split("\n")
        listed = len(lines) > 1 and all(_ITEM.match(x) for x in lines if x.strip())
        parts = [_ITEM.sub("", x, count=1).strip() for x in lines if x.strip()] if listed else o.strip().split(", ")
        if free and len(parts) > 1 and not _STOP.search(o.replace("\n", " ") if not listed else ""):
            marks = [m.group() for x in lines if (m := _ITEM.match(x))] if listed else []
            for _ in range(3):
                some = [parts[i] for i in self.r.permutation(len(parts))][: int(self.r.integers(1, len(parts) + 1))]
                out.append(((p, "\n".join(m + x for m, x in zip(marks, some)) if listed else ", ".join(some), e), -1))
        if free and len(o) > 40 and self.chance(0.05):
            out.append(((p, f'{o} "{self.refusal(p, "en").split(".")[0]}," {self.pick(("says", "said", "asks"))} the {self.pick(self.tails).split(" ")[-1].strip(".")}.', e), -1))
        if want == "en" and self.chance(0.03):
            words = p.split()
            t = self.pick(NOTES).format(topic="how " + " ".join(words[-3:]).strip(".?"))
            out.append(((p, json.dumps({"covered": False, "note": t, "parts": []}) if self.chance(0.5) else t, e), -1))
        return out


def _opening(text: str, n: int) -> str:
    return " ".join(_WORD.findall(answer_text(text).lower())[:n])


def train(rows: list[tuple[str, str, str]], seed: int = 7) -> Classifier:
    """A classifier from pairs as they come, most of which must be sound.

    Outputs that begin alike are judged by models that haven't seen them, so a refusal that comes often isn't learnt as sound;
    but what is usual for a kind of prompt (``USUAL``) stays.
    """
    # an output that many calls have counts as often as the root of their number
    n = Counter(o for _, o, _ in rows)
    kept: Counter = Counter()
    some = []
    for row in rows:
        if kept[row[1]] ** 2 < n[row[1]]:
            kept[row[1]] += 1
            some.append(row)
    rows = some
    spoil = Spoiler(rows, seed)
    made = [[(features(*x), y) for x, y in spoil(row)] for row in rows]
    own = [m[0][0] for m in made]
    asked, begun = [_opening(p, 3) for p, _, _ in rows], [_opening(o, 4) for _, o, _ in rows]
    fold = np.array([zlib.crc32(x.encode()) % FOLDS for x in begun])
    kinds, both = Counter(asked), Counter(zip(asked, begun))
    usual = np.array([both[x] >= max(3, USUAL * kinds[x[0]]) for x in zip(asked, begun)])
    sound = np.ones(len(rows), dtype=bool)
    sure: dict[int, int] = {}

    def examples(side: np.ndarray) -> tuple[list, np.ndarray]:
        some = [x for i in np.flatnonzero(sound & side) for x in made[i]] + [(own[i], k) for i, k in sure.items() if side[i]]
        return [x for x, _ in some], np.array([y for _, y in some], dtype=np.int64)

    def fitted(side: np.ndarray, epochs: int) -> Classifier:
        model = Classifier()
        some = examples(side)
        if some[0]:
            model.fit(*some, epochs=epochs, seed=seed)
        return model

    for epochs in EPOCHS[:-1]:
        m = np.empty((len(DEFECTS), len(rows)))
        for k in set(fold.tolist()):
            # at even odds: the sound examples aren't pure enough yet to calibrate by
            m[:, fold == k] = fitted(fold != k, epochs).margins([own[i] for i in np.flatnonzero(fold == k)])
        best = m.argmax(axis=0)
        sure = {i: int(k) for i, k in enumerate(best) if m[k, i] > 1.0 and not usual[i]}
        sound = (m.max(axis=0) <= 0) | usual
    held = np.arange(len(rows)) % 5 == 0
    model = fitted(~held, EPOCHS[-1])
    model.calibrate(*examples(held))
    return model


def _marker(sent):
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Classifier()
        model.dense, model.hashed, model.threshold = sent.value
        for b in batches:
            for a in range(0, len(b), 1000):
                some = b.iloc[a : a + 1000]
                found = model.defects([features(p or "", o or "", e or "") for p, o, e in zip(some["prompt"], some["output"], some["error"])])
                rows = [(i, k) for i, k in zip(some["call_id"], found) if k]
                yield pd.DataFrame(rows, columns=["call_id", "defect"]).astype({"call_id": "int64"})

    return mark


def defects(calls: DataFrame, most_training: int = 3000, longest_training: int = 20_000) -> DataFrame:
    """call_id, defect of ``calls(call_id, prompt, output, error)``.

    most_training: how many pairs, chosen by a hash of the id, the classifier is trained on, none of which has more than
    ``longest_training`` characters; all pairs are classified.
    """
    rows = calls.select(F.col("call_id").cast("long").alias("call_id"), "prompt", "output", "error")
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("prompt", "output", "error")), F.lit(0))
    # rows delivered twice have one hash, so only the few chosen have to be compared
    sample = rows.where("length(trim(output)) > 3").where(size <= longest_training).orderBy(F.xxhash64("call_id"), "call_id", "prompt", "output", "error").limit(2 * most_training).distinct()
    sample = sorted({(r["call_id"], r["prompt"] or "", r["output"] or "", r["error"] or "") for r in sample.collect()})[:most_training]
    if sample:
        model = train([r[1:] for r in sample])
    else:
        model = Classifier()
        model.dense[DEFECTS.index("empty"), DENSE.index("words_0")] = 1
    sent = calls.sparkSession.sparkContext.broadcast((model.dense, model.hashed, model.threshold))
    return spread(rows).mapInPandas(_marker(sent), "call_id long, defect string").distinct()
