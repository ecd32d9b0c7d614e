"""Language of texts by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from embergrid.llm.records import by_row

UNKNOWN = "und"
_SIGNS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-cased UTF-8 words with single blanks; ASCII signs and digits tell nothing about a language."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SIGNS).split())


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries per language. Size: at most languages x ``dictionary_bytes``."""

    dictionaries: dict[str, bytes]
    level: int = 6
    block_bytes: int = 4096
    min_margin: float = 0.005


def learn_languages(
    documents: DataFrame, *, sample_documents: int = 600, piece_chars: int = 1500, dictionary_bytes: int = 110_000,
    level: int = 6, block_bytes: int = 4096, min_margin: float = 0.005,
) -> LanguageModel:
    """Dictionaries from labelled documents (area, document, lang).

    The texts of a language with the smallest hashes, copies counted once, give a piece of at most ``piece_chars``
    characters each, from a hashed offset, until ``dictionary_bytes`` are full or its texts are used up; so every language
    with a labelled letter has a dictionary. About ``sample_documents`` texts a language are read at first, eight times
    as many as long as they don't fill it. Rows without a language or text teach nothing. No labelled row: a model without
    languages.
    """
    labelled = documents.select("document", "lang").filter(
        F.col("lang").isNotNull() & F.col("document").isNotNull() & (F.col("document") != "")
    )
    h = F.xxhash64("document")
    draw = F.shiftrightunsigned(h, 11) / float(2**53)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count_distinct(h).alias("n")).collect()}
    offset = F.pmod(F.xxhash64("document", F.lit(1)), F.greatest(F.length("document") - piece_chars + 1, F.lit(1))) + 1
    piece = F.substr("document", offset.cast("int"), F.lit(piece_chars))
    texts: dict[str, bytes] = {}
    shares = {k: sample_documents / n for k, n in sizes.items()}
    while shares:
        share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(x)) for k, x in shares.items()], F.lit(0.0))
        drawn = labelled.filter(draw < share).select("lang", draw.alias("h"), piece.alias("piece")).distinct().collect()
        texts |= dict.fromkeys(shares, b"")
        for row in sorted(drawn, key=lambda r: (r["lang"], r["h"], r["piece"])):
            have = texts[row["lang"]]
            if len(have) < dictionary_bytes and (words := plain(row["piece"])):
                texts[row["lang"]] = (have + words + b" ")[:dictionary_bytes]
        shares = {k: 8 * x for k, x in shares.items() if x < 1 and len(texts[k]) < dictionary_bytes}
    texts = {k: x for k, x in texts.items() if x}
    return LanguageModel(texts, level, block_bytes, min_margin)


def predict_language(documents: DataFrame, model: LanguageModel, *, keep: list[str] | None = None) -> DataFrame:
    """(area, lang_pred, score, margin, rejected) of every document (area, document).

    The whole text (lower case, without signs) is compressed in independent blocks of ``block_bytes``, once per language, and the
    smallest total wins; ties go to the first language by name. ``margin`` is the share by which the second
    language is larger, ``score`` = margin / (margin + 0.02) lies in 0..1. ``rejected``: margin below
    ``min_margin``, or no decision. Null text, a text without a letter, or a model without languages:
    ``und``, score 0, rejected. Repeated rows give repeated answers; other columns are left out unless
    ``keep`` names them in place of ``area``.
    """
    names = sorted(model.dictionaries)
    state: dict = {}

    def compressors():
        if not state:
            import zstandard

            for name in names:
                content = zstandard.ZstdCompressionDict(model.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=model.level)
                state[name] = zstandard.ZstdCompressor(
                    level=model.level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
                ).compress
        return [state[n] for n in names]

    def judge(texts: list) -> list[list]:
        rows, step = [], model.block_bytes
        tools = compressors()
        for text in texts:
            if not names or text is None or not any(map(str.isalpha, text)):
                rows.append((UNKNOWN, 0.0, 0.0, True))
                continue
            raw = plain(text)
            blocks = [raw[i : i + step] for i in range(0, len(raw), step)]
            sizes = [sum(len(squeeze(b)) for b in blocks) for squeeze in tools]
            order = sorted(range(len(names)), key=sizes.__getitem__)
            best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else 2 * sizes[order[0]]
            margin = (second - best) / second
            rows.append((names[order[0]], margin / (margin + 0.02), margin, margin < model.min_margin))
        return [list(c) for c in zip(*rows)] if rows else [[], [], [], []]

    return by_row(
        documents, "document", "lang_pred string, score double, margin double, rejected boolean", judge, keep or ["area"]
    )
