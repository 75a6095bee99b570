"""Broken prompt and response pairs, each with its defect: empty, truncated, refusal, copied or language.

Order of the tests: empty, an unfinished JSON object, copied, refusal, an unfinished sentence, language; the first
that holds names the row. Copies are found by compression: each sentence of the answer is compressed with its prompt as
the zstandard dictionary. What the prompt holds costs next to nothing, whatever its length; an answer is a copy if it
has such a sentence and all the rest costs no more than a short lead-in and closing words do. Refusals and languages
come from dictionaries. Whether a last full stop ends a sentence, an abbreviation or half a number is told by a
terminal-context model: how often, over all answers of the table, a full stop after such a word, or after a number of
that shape after that word, was followed by a new sentence; rare contexts are drawn towards their shape's figure and
that towards a fixed prior, so there is no least number of observations.

Nulls and blanks are ``empty``; a null prompt can't be copied and has no language. Rows are judged one by one, so
repeated rows count each; very long texts are read whole. An empty table gives an empty result. Rows whose whole text
is a JSON record with a decision in it are proper answers and stay in the JVM.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, islice

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.records import is_json, undecorated
from wattloom.llm.tables import spread
from wattloom.session import cut_table

# Words that stand for no value.
NO_VALUE = {"na", "n a", "null", "none", "nil", "nan", "undefined", "tbd", "nothing", "no answer", "no value", "no data", "missing", "void", "blank", "empty", "json", "text", "unknown", "not available", "not applicable", "keine", "keine angabe", "ninguno", "ninguna", "nada", "sin datos", "无", "空", "没有", "暂无"}
# Phrases of refusal by language.
REFUSALS = {
    "en": r"\b(can ?not|can't|can’t|unable to|not able to|won't|won’t|will not|not going to|may not|must not|must decline|have to decline|must refuse|decline to|refuse to|not (?:be )?(?:appropriate|allowed|permitted|in a position|comfortable)|against my|outside (?:of )?(?:my|what)|beyond (?:my|what)|keep(?:s)? me from|prevent(?:s)? me|do not have permission|not authori[sz]ed|rather not|would prefer not|let us talk about something else|guidelines|policy|cannot answer|no (?:advice|recommendation) from me|no [\w ]{1,40} (?:will|can|shall|may) be (?:issued|given|made|provided|offered)|not (?:for|to|up to) me|as an ai|as a language model)\b",
    "de": r"(kann ich nicht|kann (?:das|dies|dazu|hier|ihnen)\b.*\bnicht|nicht helfen|nicht möglich|möchte ich nicht|möchte .* nicht|darf (?:ich|das|dazu|hier)?.*nicht|darf ich (?:keine|nicht)|keine (?:empfehlung|auskunft|entscheidung)|lehne .* ab|ablehnen|nicht beantworten|lassen .* nicht zu|nicht erlaubt|nicht befugt|nicht in der lage|tut mir leid|muss ich .*verzichten|verweiger|leider)",
    "es": r"(no puedo|no podemos|no me (?:es posible|permiten?|corresponde|está permitido)|no (?:estoy|tengo) (?:autorizad|permiso|en condiciones)|no debo|no (?:voy a|quiero|deseo|sería apropiado|es apropiado)|lo siento|lamento|me niego|debo (?:rechazar|declinar)|prefiero no|rechazo|disculp|no responderé|no daré)",
    "fr": r"(je ne (?:peux|puis|suis|dois|vais|souhaite|saurais)|désolé|je refuse|je préfère ne pas|impossible de|ne me permettent? pas|je regrette|malheureusement)",
    "zh": r"(不能|无法|不便|抱歉|对不起|拒绝|不予|不可以|不允许|无权|遗憾|恕|不应由我|不会回答|不愿|不想)",
}
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS.values()), re.IGNORECASE | re.DOTALL)
# An answer's decision, in any of the languages.
_DECISION = re.compile(r"(?:\bactions?|\baktion(?:en)?|\bacci(?:ó|o)n(?:es)?|动作|行动|\bazione|\bação|\bactie)\s*(?:n[°o.]\s*)?\d", re.IGNORECASE)
# Frequent short words by language.
WORDS = {
    "en": "the of and to in is that it for with as was on are be this by at from or an not but which before would what you your i my there should while since so only than when where why if please more most other some such can will all has have had do does about into over after also just because until here we they he she him her his their them could",
    "de": "der die das und ist nicht ein eine einen einem einer von zu mit den dem des im für auf sich es wird bei aus auch als an nach so wie ich sie aber noch nur vor weil denn dass würde mir ihnen am kann keine warum über unter zum zur sind war hat haben wenn oder bis durch um mehr sehr doch jetzt hier ihr wir uns",
    "es": "el la los las de del que y en un una es no se por con para como más pero su al lo porque si ya sobre antes está ser muy sin qué cuál debe ahora solo también entre hasta desde donde cuando ha han son fue este esta eso esto mi me le les nos yo usted unos unas",
    "fr": "le la les de des du et en un une est que qui dans pour pas sur au aux par avec ce cette il elle je ne se plus mais ou car si nous vous aucune avant serait sont ont été être comme tout sans leur leurs même très bien donc alors son sa ses",
    "it": "il lo la i gli le di del della dello dei delle e in un una è che non per con come più ma si al alla sono da dal nel nella questa questo anche o se ha hanno essere",
    "pt": "o a os as de do da dos das e em um uma é que não por com para como mais mas se ao à são no na nos nas esta este também ou ser foi sem sua seu",
    "nl": "de het een en van is dat niet in op te met voor zijn die er aan ook als maar om bij nog naar dan wordt dit deze door over of zou kan heeft",
}
_LANGUAGES: dict[str, list[str]] = {}  # of each word
for _k, _v in WORDS.items():
    for _w in _v.split():
        _LANGUAGES.setdefault(_w, []).append(_k)
_ENDS = ".!?。！？…"
_CLOSERS = "\"'”’»)]}」』）*_` \t\r\n"
SAME, OWN, LEAST = 8, 72, 12  # bytes that a sentence of the prompt costs at most when compressed with it, bytes that all a copy's own words may cost, bytes of a sentence that tell
PRIOR, LIKE = (2.0, 3.0), 4.0  # ends and observations a shape begins with, observations of its shape a context begins with

_CONTROL = re.compile(r"<\|[^<>|]*\|>|</?s>|\[/?INST\]|<(?:eos|bos|pad|unk|end_of_turn|start_of_turn)>|[​-‏⁠﻿\x00-\x08\x0b\x0c\x0e-\x1f]", re.IGNORECASE)
_FENCE = re.compile(r"```[a-zA-Z]*")
_HINT = re.compile("[<\x00-\x08\x0b\x0c\x0e-\x1f\u200b-\u200f\u2060\ufeff]|INST\\]|inst\\]")  # what control tokens have in them
_DECODER = json.JSONDecoder()
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile("[㐀-鿿]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def bare_text(answer: str) -> str:
    """The answer without control tokens and code fences."""
    text = _CONTROL.sub(" ", answer) if _HINT.search(answer) else answer
    return _FENCE.sub(" ", text) if "```" in text else text


def flat(text: str) -> str:
    """Letters and digits only, case-folded, single blanks."""
    return " ".join(_WORD.findall(text.casefold()))


def sentences(text: str) -> list[str]:
    """Sentences of a text, a lead-in up to its colon counts as one; a full stop or colon inside a number ends nothing."""
    return [s for s in re.split(r"(?<=[.!?:])\s+|(?<=[。！？：])|[\r\n]+", text) if s.strip()]


def json_parts(text: str) -> tuple[list[object], str, bool]:
    """The complete JSON objects and arrays of a text, what is left of it, and whether a last one is unfinished."""
    values, prose, at = [], [], 0
    while True:
        k = min((x for x in (text.find("{", at), text.find("[", at)) if x >= 0), default=-1)
        if k < 0:
            return values, "".join([*prose, text[at:]]), False
        prose.append(text[at:k])
        try:
            value, at = _DECODER.raw_decode(text, k)
            values.append(value)
        except ValueError as error:
            cut = re.match(r"[{\[]\s*(?:[\"{\[\d\]}-]|$)", text[k:]) and not _balanced(text[k:])
            if cut and (text[k] == "{" or '"' in text[k:] or getattr(error, "pos", 0) >= len(text.rstrip()) - 1):
                return values, "".join(prose), True
            prose.append(text[k])
            at = k + 1


def _balanced(text: str) -> bool:
    depth, quoted, escaped = 0, False, False
    for c in text:
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return True
    return False


def _strings(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [s for v in value.values() for s in _strings(v)]
    return [s for v in value for s in _strings(v)] if isinstance(value, list) else []


def _scalars(value: object) -> int:
    if isinstance(value, dict):
        return sum(_scalars(v) for v in value.values())
    if isinstance(value, list):
        return sum(_scalars(v) for v in value)
    return int(value is not None and not (isinstance(value, str) and _no_value(value)))


def _no_value(text: str) -> bool:
    words = [m[0] for m in islice(_WORD.finditer(text), 3)]  # words that stand for no value are two at most
    return not words or (len(words) < 3 and " ".join(words).casefold() in NO_VALUE)


class Prompt:
    """What judging the answers of one prompt needs of it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.parts = [x.strip() for x in sentences(text)]

    @cached_property
    def language(self) -> str | None:
        return language(self.text)

    @cached_property
    def zstd(self) -> zstandard.ZstdCompressor | None:
        words = flat(self.text).encode()
        if len(words) < 8:  # the format's least dictionary: there is nothing to copy from
            return None
        return zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    @cached_property
    def frame(self) -> int:
        return len(self.zstd.compress(b""))

    def cost(self, sentence: str) -> tuple[int, int]:
        """Bytes of a flat sentence, and what it costs given the prompt."""
        raw = sentence.encode()
        return len(raw), len(self.zstd.compress(raw)) - self.frame


@lru_cache(maxsize=512)
def _prompt(text: str) -> Prompt:
    return Prompt(text)


def copied(answer: str, prompt: Prompt) -> bool:
    """Nothing but sentences of the prompt, apart from a short lead-in and closing words, by what each sentence costs given the prompt."""
    if prompt.zstd is None:
        return False
    taken, own = False, 0
    for s in sentences(answer):
        f = flat(s)
        size, cost = prompt.cost(f)
        if size >= LEAST and cost <= SAME:
            taken = True
        elif size >= LEAST and cost * 2 <= size:  # a lead-in and a sentence of the prompt
            taken, own = True, own + cost - SAME
        elif _DECISION.search(s) or re.search(r"\d", f):
            return False
        else:
            own += cost
        if own > OWN:
            return False
    return taken


def language(text: str) -> str | None:
    """The language most of the text's short words belong to, zh by its characters; null if there is too little to tell."""
    runs = _HAN.findall(text)
    han = sum(map(len, runs))
    words = _LETTERS.findall((_HAN.sub(" ", text) if runs else text).casefold())
    if han >= 4 and han * 2 >= sum(map(len, words)) * 0.5:
        return "zh"
    hits = Counter(chain.from_iterable(map(_LANGUAGES.__getitem__, filter(_LANGUAGES.__contains__, words)))).most_common(2)
    return hits[0][0] if hits and hits[0][1] >= 2 and (len(hits) < 2 or hits[1][1] < hits[0][1]) else None


def judge(answer: str | None, prompt: str | None, ends: float | None) -> str | None:
    """The defect of one pair; ``ends`` is the model's probability that the answer's last full stop ends a sentence."""
    if answer is None:
        return "empty"
    bare = bare_text(answer)
    if _no_value(bare):
        return "empty"
    values, prose, unfinished = json_parts(bare)
    spoken = re.search(r"\w", prose)
    if not unfinished and not spoken and not any(map(_scalars, values)):
        return "empty"
    if unfinished:
        return "truncated"
    record = any(isinstance(v, dict) and ("a" in v or "b" in v or "e" in v) for v in values)
    inner = " ".join(s for v in values for s in _strings(v))
    own = f"{prose} {inner}".strip()
    if not re.search(r"\w", own):
        return None
    asked = _prompt(prompt or "")
    if not record and copied(own, asked):
        return "copied"
    for s in asked.parts:
        own = own.replace(s, " ")
    if not record and not _DECISION.search(own) and _REFUSAL.search(own):
        return "refusal"
    # the text stops with the prose: is the last sentence complete?
    tail = bare.rstrip(_CLOSERS)
    if spoken and not (values and bare.rstrip()[-1:] in "}]"):
        if tail[-1:] not in _ENDS or (tail[-1:] == "." and ends is not None and ends < 0.5):
            return "truncated"
    if spoken:
        mine = language(" ".join(own.replace(inner, " ").split()) if inner else own)
        if mine and asked.language and mine != asked.language:
            return "language"
    return None


# a word or number before a full stop: the number's last word before it, and what follows
_NUMBER = r"(?:\p{Nd}+[:-])*\p{Nd}+(?:\.\p{Nd}+)?"
_PROSE = r"\{[^{}]*\}?|\[[^\[\]]*\]?|[\"{}\[\],]+"  # what is no prose: whole objects and lists, also unfinished ones
_SEEN = rf"(?:\b\p{{L}}{{1,12}}[^\p{{L}}\p{{Nd}}]{{0,3}})?{_NUMBER}(?:\.(?=\s+\p{{L}}))?|\b\p{{L}}{{1,12}}\.(?=\s+[\p{{Ll}}\p{{Nd}}])|\b\p{{L}}{{1,12}}\.\s(?=\s*\p{{L}})"
# the same at the end of an answer, read backwards
_LAST = r"^[\s\p{P}`]*?\.(\p{Nd}[\p{Nd}:,.-]*)?[^\p{L}\p{Nd}]{0,3}(\p{L}{1,12})?"


def _shape(number: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(number, r"\p{Nd}+", "9"), r"^-", "")


def terminal_contexts(answers: DataFrame, text: str) -> DataFrame:
    """(context, p): the probability that a full stop in a context ends a sentence.

    A context is a word before the full stop, or a number's shape with the word before it. A sentence has ended if a
    word with a capital (or of a script without capitals) follows; a small letter or a number goes on, as do digits
    after a number's full stop.
    """
    answers = answers.where(F.col(text).rlike(r"\p{Lu}") | ~F.col(text).rlike(r"\p{Ll}"))  # where no sentence begins with a capital, small letters tell nothing
    bare = F.regexp_replace(text, _PROSE, " ")
    found = F.explode(F.regexp_extract_all(F.regexp_replace(bare, r"\p{Nd}+", "9"), F.lit(_SEEN), F.lit(0)))  # shapes and words are few
    d = answers.select(found.alias("m")).where(F.col("m").contains(".")).groupBy("m").agg(F.count("*").alias("n"))
    number = F.regexp_extract("m", r"(?:9[:-])*9(?:\.9)?\.?$", 0)
    word = F.regexp_extract("m", r"^\p{L}+", 0)
    ended, goes_on = F.col("m").rlike(r"\p{L}\.\s$"), F.col("m").rlike(r"\p{L}\.$")
    evidence = F.array(
        F.when(ended | goes_on, F.struct(word.alias("w"), F.lit("").alias("s"), F.when(ended, 1).otherwise(0).alias("end"))),
        F.when(number.contains(".9"), F.struct(word.alias("w"), F.split_part(number, F.lit("."), F.lit(1)).alias("s"), F.lit(0).alias("end"))),
        F.when(number.endswith("."), F.struct(word.alias("w"), F.rtrim(number, F.lit(".")).alias("s"), F.lit(1).alias("end"))),
    )
    d = d.select("n", F.explode(F.array_compact(evidence)).alias("x")).groupBy("x.w", "x.s").agg(F.sum(F.col("n") * F.col("x.end")).alias("ends"), F.sum("n").alias("n"))
    shape = d.groupBy("s").agg(((F.sum("ends") + PRIOR[0]) / (F.sum("n") + PRIOR[1])).alias("_q"))
    one = d.join(shape, "s").select(F.concat_ws("|", "w", "s").alias("context"), ((F.col("ends") + LIKE * F.col("_q")) / (F.col("n") + LIKE)).alias("p"))
    return one.unionByName(shape.where("s <> ''").select(F.concat(F.lit("*|"), "s").alias("context"), F.col("_q").alias("p")))


def defects(pairs: DataFrame, row_id: str, prompt: str, answer: str) -> DataFrame:
    """(row_id, defect_type) of every row that is no proper answer."""
    pairs = spread(pairs.select(F.col(row_id).alias("row_id"), F.col(prompt).alias("prompt"), F.col(answer).alias("answer")))
    model = cut_table(terminal_contexts(pairs, "answer"))
    whole = is_json(undecorated(F.col("answer"))) & F.coalesce(F.get_json_object(undecorated(F.col("answer")), "$.a").rlike(r"\p{Nd}"), F.lit(False))
    last = lambda k: F.reverse(F.regexp_extract(F.reverse("answer"), _LAST, k))
    d = pairs.where(F.col("answer").isNull() | ~whole).withColumns({"_s": _shape(last(1)), "_w": last(2)})
    d = d.withColumns({"_context": F.concat_ws("|", "_w", "_s"), "_any": F.when(F.col("_s") != "", F.concat(F.lit("*|"), "_s"))})
    d = d.join(model.select(F.col("context").alias("_context"), F.col("p").alias("_p")), "_context", "left")
    d = d.join(model.select(F.col("context").alias("_any"), F.col("p").alias("_q")), "_any", "left")
    d = d.select("row_id", "prompt", "answer", F.coalesce("_p", "_q").alias("ends"))
    return d.mapInArrow(_judge_all, f"row_id {pairs.schema['row_id'].dataType.simpleString()}, defect_type string").where("defect_type IS NOT NULL")


def _judge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(b.column(2).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())
        yield pa.record_batch([b.column(0), pa.array([judge(*r) for r in rows], pa.string())], names=["row_id", "defect_type"])
