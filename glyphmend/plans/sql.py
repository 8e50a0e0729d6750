"""DuckDB fragments that the oracle queries share: scalar expressions and named common tables."""

from __future__ import annotations

from glyphmend.functions.letters import ACCENTED, PLAIN
from glyphmend.functions.sentences import ABBREVIATIONS, AZ_LETTERS
from glyphmend.operators.context import VOCABULARY

WORD = "[\\p{L}\\p{Nl}\\p{No}]+(?:[''’][\\p{L}\\p{Nl}\\p{No}]+)*"


def lower(x: str) -> str:
    return f"lower(translate({x}, 'Iİ', 'ıi'))"


def upper(x: str) -> str:
    # DuckDB has a capital for ß.
    return f"replace(upper(translate({x}, 'iı', 'İI')), 'ẞ', 'SS')"


def strip(x: str) -> str:
    return f"translate({x}, '{ACCENTED}', '{PLAIN}')"


def key(x: str) -> str:
    return strip(lower(x))


def is_upper(x: str) -> str:
    return f"({x} = upper({x}) and {x} <> lower({x}))"


def capitals(x: str) -> str:
    only = f"regexp_replace({x}, '\\P{{L}}', '', 'g')"
    return f"(length({only}) > 1 and not regexp_matches({only}, '[^\\p{{Lu}}]'))"


def restored_case(typed: str, form: str) -> str:
    return (
        f"case when length({typed}) > 1 and {is_upper(typed)} then {upper(form)} when {is_upper(f'substr({typed}, 1, 1)')}"
        f" then {upper(f'substr({form}, 1, 1)')} || substr({form}, 2) else {form} end"
    )


def applied(word: str, form: str) -> str:
    cased = restored_case(word, form)
    return f"case when {form} is null then {word} when {strip(cased)} = {strip(word)} then {cased} else {word} end"


def bucket(x: str) -> str:
    return f"(('0x' || substr(sha1({x}), 1, 2))::int % 100)"


def split_name(x: str, dev: int = 5, test: int = 10) -> str:
    return f"case when {bucket(x)} < {dev} then 'dev' when {bucket(x)} < {test} then 'test' else 'train' end"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def usable(s: str) -> str:
    letters = count(s, "\\p{L}")
    return (
        f"(length({s}) between 20 and 300 and {count(s, '[^ ]+')} >= 4 and not regexp_matches({s}, '[|={{}}\\[\\]<>]') and regexp_matches({s}, '^\\p{{L}}')"
        f" and {letters} / length({s}) >= 0.6 and {letters} = {count(s, f'[{AZ_LETTERS}a-zA-Z]')})"
    )


#: name -> (needed tables, SQL)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "tok": ((), f"""select doc_id, pos, word, {lower('word')} as form, {key('word')} as key from (
        select doc_id, unnest(range(len(ws))) as pos, unnest(ws) as word from (select doc_id, regexp_extract_all(text, '{WORD}') as ws from documents))"""),
    "lex": (("tok",), "select key, form, count(*) as n, min(doc_id * 100000000 + pos) as seen from tok group by key, form"),
    "ranked": (("lex",), "select *, row_number() over (partition by key order by n desc, seen) as rk, sum(n) over (partition by key) as total, count(*) over (partition by key) as forms from lex"),
    "best": (("ranked",), "select key, form, n, total, forms from ranked where rk = 1"),
    "ambiguous": (("ranked",), "select key, n as runner_up, total from ranked where rk = 2 and n >= 10 and n / total >= 0.05"),
    "near": (("tok",), "select *, lag(key, 1, '<s>') over (partition by doc_id order by pos) as l, lead(key, 1, '</s>') over (partition by doc_id order by pos) as r from tok"),
    "vocab": (("lex",), f"select key, sum(n) as total from lex group by key order by total desc, key limit {VOCABULARY}"),
    "feat": (("near", "ambiguous", "vocab"), """select n.doc_id, n.pos, n.key, n.form, n.word,
        case when n.l in ('<s>', '</s>') then n.l else coalesce(a.key, '<unk>') end as l, case when n.r in ('<s>', '</s>') then n.r else coalesce(b.key, '<unk>') end as r
        from near n join ambiguous m on m.key = n.key left join vocab a on a.key = n.l left join vocab b on b.key = n.r"""),
    "cform": (("feat",), "select key, form, count(*) as n, min(doc_id * 100000000 + pos) as seen from feat group by key, form"),
    "cside": (("feat",), """select key, form, side, feature, count(*) as n, min(plc) as seen from (
        select key, form, 'left' as side, l as feature, doc_id * 100000000 + pos as plc from feat union all select key, form, 'right', r, doc_id * 100000000 + pos from feat) group by all"""),
    "ckept": (("cside",), "select key, form, side, feature, n from (select *, row_number() over (partition by key, form, side order by n desc, seen, feature) as rk from cside) where rk <= 200 and n >= 2"),
    "asked": (("feat",), "select distinct key, l, r from feat"),
    "scored": (("asked", "cform", "ckept", "vocab"), """select q.key, q.l, q.r, f.form, f.seen,
        round(ln(f.n / f.total) + ln((coalesce(a.n, 0) + 1.0) / (coalesce(k.kl, 0) + 1.0 * v.features)) + ln((coalesce(b.n, 0) + 1.0) / (coalesce(k.kr, 0) + 1.0 * v.features)), 9) as score
        from asked q join (select *, sum(n) over (partition by key) as total from cform) f on f.key = q.key
        left join (select key, form, sum(case when side = 'left' then n else 0 end) as kl, sum(case when side = 'right' then n else 0 end) as kr from ckept group by 1, 2) k on k.key = f.key and k.form = f.form
        left join ckept a on a.key = f.key and a.form = f.form and a.side = 'left' and a.feature = q.l
        left join ckept b on b.key = f.key and b.form = f.form and b.side = 'right' and b.feature = q.r
        cross join (select count(*) + 3 as features from vocab) v"""),
    "cbest": (("scored",), "select key, l, r, form, score from (select *, row_number() over (partition by key, l, r order by score desc, seen) as rk from scored) where rk = 1"),
    "typed": ((), f"select doc_id, text, {strip('text')} as typed from documents"),
    "ttok": ((), f"""select doc_id, pos, word, gap, {key('word')} as key from (select doc_id, unnest(range(len(gs))) as pos, unnest(list_concat(ws, [null])) as word, unnest(gs) as gap from (
        select doc_id, regexp_extract_all(t, '{WORD}') as ws, string_split_regex(t, '{WORD}') as gs from (select doc_id, {strip('text')} as t from documents)))"""),
    "lexout": (("ttok", "best"), f"select t.doc_id, t.pos, t.word, t.gap, t.key, {applied('t.word', 'b.form')} as out from ttok t left join best b on b.key = t.key"),
    "restored": (("lexout",), "select doc_id, string_agg(gap || coalesce(out, ''), '' order by pos) as restored from lexout group by doc_id"),
    "pair": (("tok", "lexout"), "select t.doc_id, t.pos, t.word as expected, o.out as produced, t.key from tok t join lexout o on o.doc_id = t.doc_id and o.pos = t.pos and o.word is not null"),
    "piece": ((), """select doc_id, plc, piece from (select doc_id, unnest(range(len(ps))) as plc, trim(unnest(ps), ' ' || chr(9) || chr(10) || chr(13)) as piece from (
        select doc_id, string_split_regex(regexp_replace(text, '([.!?…])[ \\t]+', '\\1' || chr(10), 'g'), '\\n+') as ps from documents)) where piece <> ''"""),
    "sent": (("piece",), f"""select doc_id, sent_pos, string_agg(piece, ' ' order by plc) as sentence from (
        select *, coalesce(sum(case when glue then 0 else 1 end) over (partition by doc_id order by plc rows between unbounded preceding and 1 preceding), 0)::bigint as sent_pos from (
        select *, w <> '' and (length(w) <= 1 or lower(w) in ({", ".join(f"'{a}'" for a in ABBREVIATIONS)})) as glue from (
        select *, regexp_extract(piece, '([^\\s.]+)\\.\\s*$', 1) as w from piece))) group by doc_id, sent_pos"""),
    "norm": (("sent",), f"select *, {usable('sentence')} as usable from (select doc_id, sent_pos, nfc_normalize(trim(regexp_replace(sentence, '\\s+', ' ', 'g'))) as sentence from sent)"),
    "corpus": (("norm",), f"""select {split_name('doc_id::varchar')} as split, doc_id, sent_pos, sentence from (
        select *, row_number() over (partition by {lower('sentence')} order by doc_id, sent_pos) as nth from norm where usable) where nth = 1"""),
    "words": (("best",), "select key, form, total as n from best"),
    "known": (("words",), "select key, form, n from words where n >= 5"),
    "cuts": (("known",), "select key, c, substr(key, 1, c) as stem, substr(key, c + 1) as ending from (select key, unnest(range(4, length(key))) as c from known where length(key) > 4)"),
    "alpha": ((), "select unnest(string_split('abcdefghijklmnopqrstuvxyz', '')) as ch"),
}


def query(select: str, *needed: str) -> str:
    """select with the named tables, and all that they need, before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in TABLES[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needed:
        visit(n)
    return (f"with {', '.join(f'{n} as materialized ({TABLES[n][1]})' for n in order)} " if order else "") + select
