"""Language detection: a pluggable detector, and the rules that turn its answer into a code.

The built-in detector is naive Bayes over runs of one to three letters, with
profiles counted from the short ``SAMPLES``; letters of a script that one
language of the map uses are one letter, so such a script names its language.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the detector and those that are stored, characters read, default and least probability.
CODES = {"ja": "ja", "en": "en", "zh-cn": "zh", "zh-tw": "zh", "ko": "ko", "es": "es", "fr": "fr", "de": "de", "it": "it", "pt": "pt", "ru": "ru", "ar": "ar", "hi": "hi"}
READ = 10_000
DEFAULT = "ja"
THRESHOLD = 0.7
FLOOR = 1e-4

#: The first article of the declaration of human rights and frequent words.
SAMPLES = {
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood the of and to in is that it was for on with as be at by this have from or had not but what were when we there can an your which their said if will each about how up out them then she many some so these would other into has more her two him time no make than first been who now people my made over did down only way find use may water long little very after words called just where most know",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón y conciencia deben comportarse fraternalmente los unos con los otros de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada vida otro después te otros aunque esa eso hace otra gobierno",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ont été cette mais aux comme nous leur même ses fait elle deux ou si tout on ces sans être peut après ans entre dont aussi encore où bien très depuis était contre avant autres tous celui mon toujours quand notre vous faire avoir leurs moins jour rien",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geist der brüderlichkeit begegnen der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn kann gegen vom schon ihre jahr unter wir soll ich eines zwei jahren diese dieser wieder keine seiner sehr hier alle können",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza di e il la che in a per un del è le una della non i con si da sono al dei come nel più alla anche ma ha lo delle gli o se su ci questo dalla degli anni due dal essere stato quello nella tra ai solo suo prima era dopo molto quando ho hanno perché tutto sua loro così fatto ancora senza sempre dove già chi poi ora io cosa mio ogni tempo",
    "pt": "todos os seres humanos nascem livres e iguais em dignidade e em direitos dotados de razão e de consciência devem agir uns para com os outros em espírito de fraternidade de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja qual será nós tenho",
    "ru": "я",
    "ar": "ع",
    "hi": "अ",
    "ko": "가",
    "ja": "一あああ一一あああああ一一あ一ああアアアア一一あああ一ああ一一一ああ",
    "zh-cn": "一一一一一一一一一一",
}
_SCRIPTS = [(re.compile(f"[{a}]"), one) for a, one in (("Ѐ-ӿ", "я"), ("؀-ۿ", "ع"), ("ऀ-ॿ", "अ"), ("ᄀ-ᇿ가-힯", "가"), ("぀-ゟ", "あ"), ("゠-ヿ", "ア"), ("㐀-鿿", "一"))]


def _words(text: str) -> Counter:
    text = text.lower()
    for letters, one in _SCRIPTS:
        text = letters.sub(one, text)
    return Counter(re.findall(r"[^\W\d_]+", text))


def _grams(word: str) -> list[str]:
    edged = f" {word} "
    return [edged[k : k + n] for n in (1, 2, 3) for k in range(len(edged) - n + 1) if edged[k : k + n] != " "]


@functools.cache
def _profiles() -> dict[str, np.ndarray]:
    """Log shares of each run of letters, among runs of its length, in the order of ``SAMPLES``."""
    counts = []
    for sample in SAMPLES.values():
        found: Counter = Counter()
        for word, times in _words(sample).items():
            for g in _grams(word):
                found[g] += times
        counts.append(found)
    totals = [[sum(v for g, v in f.items() if len(g) == n) or 1 for n in (1, 2, 3)] for f in counts]
    return {g: np.log([f[g] / t[len(g) - 1] + FLOOR for f, t in zip(counts, totals, strict=True)]) for g in set().union(*counts)}


@functools.lru_cache(maxsize=200_000)
def _score(word: str) -> np.ndarray | None:
    """Log probabilities of a word; None if no profile has any of its runs."""
    table = _profiles()
    known = [table[g] for g in _grams(word) if g in table]
    return np.sum(known, axis=0) if known else None


def by_profiles(texts: list[str]) -> list[tuple[str | None, float]]:
    """(most probable code, its probability) per text; no code for a text without a known letter."""
    codes = list(SAMPLES)
    out: list[tuple[str | None, float]] = []
    for t in texts:
        known = [(v, n) for w, n in _words(t).items() if (v := _score(w)) is not None]
        if not known:
            out.append((None, 0.0))
            continue
        score = np.array([n for _, n in known]) @ np.array([v for v, _ in known])
        p = np.exp(score - score.max())
        out.append((codes[int(p.argmax())], float(p.max() / p.sum())))
    return out


def detected(text: Column, detector: Callable[[list[str]], list[tuple[str | None, float]]] = by_profiles) -> Column:
    """(code, prob) by the detector of the text's first characters; nulls for blank and null texts."""

    @F.pandas_udf("code string, prob double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            blank = [not (t and t.strip()) for t in texts]
            made = iter(detector([t for t, b in zip(texts, blank, strict=True) if not b]))
            yield pd.DataFrame([(None, None) if b else next(made) for b in blank], columns=["code", "prob"])

    return run(F.substring(text, 1, READ))


def language_code(found: Column, mode: str = "faithful", default: str = DEFAULT, threshold: float = THRESHOLD) -> Column:
    """The stored code of what ``detected`` gave.

    The default where there is no answer, a low probability or a code outside
    the map.  A confident answer is null as written, its code as intended.
    """
    if mode not in ("faithful", "intended"):
        raise ValueError(f"unknown mode {mode}")
    code = F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), found["code"])
    sure = F.coalesce((found["prob"] >= threshold) & code.isNotNull(), F.lit(False))
    return F.when(~sure, F.lit(default)).when(F.lit(mode == "intended"), code)
