"""Quality rules, lines first.

Every line is judged by itself: punctuation (shouted, unpunctuated or stuttering runs), navigation
(separator-laden menus, lines that are nothing but a link's caption, symbol-laden lines) and boilerplate
(licence, copyright and consent notices), with the captions and notices of English, French, German and Spanish
pages whatever the document's language. Failing lines go; what is left is the cleaned text, and a document
that lost too large a part of its words' characters to failing lines is rejected. The base counts are taken
on the text as given.

Edge cases: null and empty texts have no words and fail the base rule; repeated rows give repeated
results; texts are processed whole, a document at a time; an empty table gives no rows; other columns are
not read."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import raw_texts, ship, slices, table, tidied

SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
MARKS = re.compile("[.,;:!?\u2026\u3001\u3002\uff01\uff0c\uff1f]")
#: What stands between the entries of a menu, with white space or an end of the line on both sides, or a bar.
SEPARATORS = re.compile("\\||(?<!\\S)[\u00b7\u2022\u203a/](?!\\S)")
#: Phrases of notices rather than prose; a line that has one is boilerplate if it is short.
NOTICES = {
    "en": r"all rights reserved|licensed under|released under the|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|"
    r"accept (?:all )?cookies|copyright \(c\)|subscribe to our newsletter|enable javascript|lorem ipsum",
    "fr": r"tous droits réservés|sous licence|conditions (?:générales )?d['’]utilisation|mentions légales|politique de confidentialité|"
    r"accepter (?:tous )?les cookies|politique (?:relative aux|en matière de) cookies|inscrivez-vous à notre newsletter|activer javascript",
    "de": r"alle rechte vorbehalten|lizenziert unter|unter der lizenz|nutzungsbedingungen|allgemeine geschäftsbedingungen|datenschutzerklärung|"
    r"cookie-(?:richtlinie|einstellungen)|(?:alle )?cookies akzeptieren|newsletter abonnieren|javascript aktivieren",
    "es": r"todos los derechos reservados|bajo (?:la )?licencia|términos (?:de uso|del servicio)|aviso legal|política de (?:privacidad|cookies)|"
    r"aceptar (?:todas )?las cookies|suscr[ií]b(?:ase|ete) a nuestro boletín|activ(?:ar|e|a) javascript",
}
NOTICE = re.compile("|".join(NOTICES.values()), re.IGNORECASE)
#: Captions of links; a line that is one of them, marks and arrows at its ends apart, is navigation.
CAPTIONS = {
    "en": "skip to content, skip to main content, back to top, read more, learn more, next page, previous page, log in, sign in, sign up, share this, leave a comment",
    "fr": "aller au contenu, retour en haut, lire la suite, en savoir plus, page suivante, page précédente, se connecter, s'inscrire, partager, laisser un commentaire",
    "de": "zum inhalt springen, nach oben, weiterlesen, mehr erfahren, nächste seite, vorherige seite, anmelden, registrieren, teilen, kommentar schreiben",
    "es": "saltar al contenido, volver arriba, leer más, más información, página siguiente, página anterior, iniciar sesión, registrarse, compartir, dejar un comentario",
}
CAPTION = frozenset(c for k in CAPTIONS.values() for c in k.split(", "))
LONGEST_CAPTION = max(len(c.split()) for c in CAPTION)
ENDS = " .:!\u2026<>\u00ab\u00bb\u2039\u203a\u2190\u2192"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    symbols_per_word: float = 0.3
    separators: int = 3
    separators_per_word: float = 0.2
    shout_words: int = 5
    unpunctuated_words: int = 40
    notice_words: int = 25
    stutter_words: int = 12
    stutter_share: float = 0.6
    max_lost: float = 0.5


def line_fault(line: bytes, words: list[bytes], rules: Rules) -> str | None:
    """The rule that a line with words fails, or None."""
    n, text = len(words), line.decode("utf-8", "replace")
    separators = len(SEPARATORS.findall(text))
    if separators >= rules.separators and separators >= rules.separators_per_word * n:
        return "navigation"
    if len(line) - len(line.translate(None, SYMBOLS)) >= max(3, rules.symbols_per_word * n):
        return "navigation"
    # Ends that are words of their own, as arrows are, come beside the caption.
    if n <= LONGEST_CAPTION + 2 and " ".join(text.lower().replace("’", "'").strip(ENDS).split()) in CAPTION:
        return "navigation"
    if n >= rules.shout_words and text.isupper():
        return "punctuation"
    if n >= rules.unpunctuated_words and not MARKS.search(text):
        return "punctuation"
    if n >= rules.stutter_words and sum(map(eq, words, words[1:])) >= rules.stutter_share * n:
        return "punctuation"
    if n <= rules.notice_words and NOTICE.search(text):
        return "boilerplate"
    return None


def n_chars(text: bytes) -> int:
    """Code points other than ASCII white space."""
    packed = np.frombuffer(text.translate(None, SPACE), np.uint8)
    return int(np.count_nonzero((packed & 0xC0) != 0x80))


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of eight words that the text has twice or more. Windows are named exactly, by
    naming pairs of equal-length halves three times over."""
    n = len(words)
    if n < WINDOW + 1:
        return 0
    names: defaultdict = defaultdict()
    names.default_factory = names.__len__
    rank, width = np.fromiter(map(names.__getitem__, words), np.int64, n), 1
    while width < WINDOW:
        top = int(rank.max()) + 1
        if top == len(rank):
            return 0
        _, rank = np.unique(rank[:-width] * top + rank[width:], return_inverse=True)
        width *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def judge(text: bytes, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost, cleaned text)."""
    words = text.split()
    n, chars = len(words), n_chars(text)
    repeat = repeat_words(words)
    seen: set[bytes] = set()
    dup, lost, clean = 0, 0, []
    for line in text.split(b"\n"):
        mine = line.split()
        if mine:
            dup += line in seen
            seen.add(line)
            if line_fault(line, mine, rules):
                lost += n_chars(line)
                continue
        clean.append(line)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    share = lost / chars if chars else 0.0
    return n, chars, len(text) - len(text.translate(None, SYMBOLS)), dup, repeat, failed, not failed and share <= rules.max_lost, share, b"\n".join(clean)


def clean_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, text) -> doc_id, the counts, base_failed, kept, lost_share and the cleaned text."""
    ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_share", "clean_text"]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = list(zip(*(judge(x, rules) for x in raw_texts(part.column(1))), strict=True)) or [[]] * len(names)
                made = [pa.array(c, pa.binary()).cast(pa.string()) if k == pa.string() else pa.array(c, k) for c, k in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_share double, clean_text string"
    return docs.select("doc_id", "text").mapInArrow(tidied(run), ddl)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")
