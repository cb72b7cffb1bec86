"""Fill-in-the-middle: texts cut in three at code points, and written with the middle at the end.

The cuts come from a hash of the seed and the doc_id, so they are the same in every run and for every partitioning. They are
code points; the bytes they stand at are found through a sparse index of the multibyte characters (`codepoints`), so
text is handled as bytes and never decoded. One pass, no shuffle.

Form `psm` is <P>prefix<S>suffix<M>middle, `spm` <S>suffix<P>prefix<M>middle, `plain` the text as it is: a share of the
documents, and every text that is empty or holds one of the marks, so marks in an output are always ours. `rebuilt`
gives the text back from output and form.

Defined results: a NULL text is empty, hence plain with an empty output. A NULL doc_id hashes as no digits. Repeated rows
give equal rows; an empty table gives none. Other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .codepoints import CodePoints
from .frames import documents, fields, map_pieces, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_PERCENT, SPM_PERCENT = 1, 10, 20


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four repeatable numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def marked(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts hold a mark?"""
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8))]
    text = np.searchsorted(bounds, at, "right") - 1
    out = np.zeros(len(bounds) - 1, bool)
    out[text[at + 3 <= bounds[text + 1]]] = True
    return out


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars (NULL if plain), output."""
    def cut(piece: pa.RecordBatch) -> dict:
        data, bounds = words.text_bytes(piece.column("text"), lower=False)
        points = CodePoints(data, bounds)
        h = np.array([draws(i, seed) for i in piece.column("doc_id").to_pylist()], np.int64).reshape(-1, 4)
        a, b = (h[:, i] % (points.counts + 1) for i in (0, 1))
        a, b = np.minimum(a, b), np.maximum(a, b)
        plain = (points.counts == 0) | marked(data, bounds) | (h[:, 2] % 100 >= 100 - plain_percent)
        spm = h[:, 3] % 100 < spm_percent
        text = np.arange(len(a))
        cuts = zip(bounds[:-1].tolist(), points.to_bytes(text, a).tolist(), points.to_bytes(text, b).tolist(), bounds[1:].tolist())
        raw, p, s, m = data.tobytes(), *(x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        output = [raw[i:l] if is_plain else s + raw[k:l] + p + raw[i:j] + m + raw[j:k] if is_spm else p + raw[i:j] + s + raw[k:l] + m + raw[j:k]
                  for (i, j, k, l), is_plain, is_spm in zip(cuts, plain.tolist(), spm.tolist())]
        return {"doc_id": piece.column("doc_id"), "n": points.counts, "form": np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(),
                "prefix_chars": pa.array(a, mask=plain), "middle_chars": pa.array(b - a, mask=plain), "output": pa.array(output, pa.binary()).cast(pa.string())}
    return map_pieces(documents(docs), "text", cut, fields("doc_id:bigint", "n:bigint", "form:string", "prefix_chars:bigint", "middle_chars:bigint", "output:string"))


def rebuilt(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    unmarked = lambda end: F.substring(F.substring_index(output, end, 1), len(PREFIX) + 1, 2 ** 31 - 1)        # noqa: E731
    after = lambda mark: F.substring_index(output, mark, -1)                                                  # noqa: E731
    middle = after(MIDDLE)
    first, last = F.substring_index(after(SUFFIX), MIDDLE, 1), F.substring_index(after(PREFIX), MIDDLE, 1)
    return F.when(form == "psm", F.concat(unmarked(SUFFIX), middle, first)).when(form == "spm", F.concat(last, middle, unmarked(PREFIX))).otherwise(output)


def op12_fill_in_middle(spark, folder: str) -> DataFrame:
    filled = fill_in_middle(table(spark, folder, "documents"))
    return filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                         F.sha2(rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
with hashed as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (select doc_id, text, cast(length(text) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
                 cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from hashed),
cut as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
               case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
parts as (select *, substring(text, 1, a) as prefix, substring(text, a + 1, b - a) as middle, substring(text, b + 1) as suffix from cut),
made as (select *, case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output from parts),
found as (select *, strpos(output, '<P>') as p, strpos(output, '<S>') as s, strpos(output, '<M>') as m from made)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars, sha256(output) as output_sha256,
       sha256(case form when 'plain' then output when 'psm' then substring(output, p + 3, s - p - 3) || substring(output, m + 3) || substring(output, s + 3, m - s - 3)
                        else substring(output, p + 3, m - p - 3) || substring(output, m + 3) || substring(output, s + 3, p - s - 3) end) as restored_sha256
from found
"""
