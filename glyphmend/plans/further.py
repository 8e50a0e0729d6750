"""Further registered queries of the restoration engine: tagger and hybrid, evaluation, spelling, requests, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmend.facade import Engine
from glyphmend.functions import letters as L
from glyphmend.operators import analysis, annotate, chat, scoring, spelling, tagger, training
from glyphmend.operators import context as ctx
from glyphmend.operators import restore as R
from glyphmend.operators.stored import stored
from glyphmend.plans import catalogue as C
from glyphmend.plans import sql as Q
from glyphmend.plans.catalogue import SQL, docs, kept_lexicon, query, typed, vocabulary
from glyphmend.streaming.limits import limited

# Tagger and hybrid


LETTERED = (
    C.CHARS.replace("letters as (", "letters as materialized (").replace("select doc_id, around, label from", "select doc_id, plc, c, around, label from").replace("(select doc_id, c, (c <> t)", "(select doc_id, plc, c, (c <> t)")
    + """,
    askedctx as materialized (select around, radius, substr(around, 5 - radius, 2 * radius + 1) as ctx from (select distinct around from chars) cross join (select unnest([1, 2, 3, 4])::int as radius)),
    widest as materialized (select around, max_by(marked / seen, radius) as p from askedctx join model using (radius, ctx) group by around)"""
)
TAGGED = f"""{LETTERED},
    tagged as materialized (select d.doc_id, coalesce(t.tagged, {Q.strip('d.text')}) as tagged from documents d left join (
    select l.doc_id, string_agg(case when w.p > 0.5 then translate(l.c, '{L.PLAIN}', '{L.ACCENTED}') else l.c end, '' order by l.plc) as tagged
    from letters l left join chars h on h.doc_id = l.doc_id and h.plc = l.plc left join widest w on w.around = h.around group by l.doc_id) t using (doc_id)),
    tagword as materialized (select doc_id, unnest(range(len(ws))) as pos, unnest(ws) as word from (select doc_id, regexp_extract_all(tagged, '{Q.WORD}') as ws from tagged)),
    hybrid as materialized (select t.doc_id, t.pos, t.gap, t.word, case when b.key is not null then {Q.applied('t.word', 'b.form')} else g.word end as out, case when b.key is not null then 'dictionary' else 'model' end as source
    from ttok t left join tagword g on g.doc_id = t.doc_id and g.pos = t.pos left join (select key, form from best where forms = 1 and n >= 3) b on b.key = t.key)"""


def hybrid(spark, d):
    model = stored(tagger.train(docs(spark, d), id_col="doc_id", text_col="text"))
    return model, R.HybridRestorer(lambda t: tagger.tag(t, model), kept_lexicon(spark, d))


@query("select doc_id, md5(string_agg(gap || coalesce(out, ''), '' order by pos)) as restored from hybrid group by doc_id", "ttok", "best", more=TAGGED)
def restore_hybrid(spark, d):
    out = hybrid(spark, d)[1].transform(typed(spark, d), id_col="doc_id", text_col="typed")
    return out.select("doc_id", F.md5("restored").alias("restored"))


@query(f"""select h.doc_id, h.start::bigint as start, (h.start + length(h.word))::bigint as "end", h.word as typed, h.out as "to", h.source,
    case when h.source = 'model' then round(min(greatest(coalesce(w.p, 0), 1 - coalesce(w.p, 0))), 6) end as confidence from (
    select *, sum(length(gap) + coalesce(length(word), 0)) over (partition by doc_id order by pos rows unbounded preceding) - coalesce(length(word), 0) as start from hybrid) h
    left join chars c on c.doc_id = h.doc_id and c.plc >= h.start and c.plc < h.start + length(h.word) left join widest w on w.around = c.around
    where h.word <> h.out group by h.doc_id, h.start, h.word, h.out, h.source""", "ttok", "best", more=TAGGED)
def explained_words(spark, d):
    """Every word that the hybrid restorer changes, who decided it, and how sure the model was of its least sure letter."""
    model, restorer = hybrid(spark, d)
    rows = stored(restorer.words(typed(spark, d), id_col="doc_id", text_col="typed", changed=True))
    sure = tagger.probabilities(typed(spark, d).select("doc_id", "typed"), model, id_col="doc_id", text_col="typed")
    return R.explained(rows, sure, id_col="doc_id").withColumn("confidence", F.round("confidence", 6))


@query("""select doc_id, count(*) as decided, sum((p > 0.1 and p < 0.9)::int)::bigint as hesitant, (array_agg(plc order by abs(p - 0.5), plc))[1]::int as closest from (
    select c.doc_id, c.plc, coalesce(w.p, 0) as p from chars c left join widest w on w.around = c.around) group by doc_id""", more=LETTERED)
def unsure_letters(spark, d):
    model = stored(tagger.train(docs(spark, d), id_col="doc_id", text_col="text"))
    found = tagger.probabilities(typed(spark, d).select("doc_id", "typed"), model, id_col="doc_id", text_col="typed")
    close = (F.col("probability") > 0.1) & (F.col("probability") < 0.9)
    # Letters as far from one half are counted first, in hash tables; a text's few distances are then compared.
    apart = found.groupBy("doc_id", F.abs(F.col("probability") - 0.5).alias("apart")).agg(F.count(F.lit(1)).alias("n"), F.count_if(close).alias("close"), F.min("at").alias("at"))
    return apart.groupBy("doc_id").agg(F.sum("n").alias("decided"), F.sum("close").alias("hesitant"), F.min_by("at", F.struct("apart", "at")).alias("closest"))


@query(f"""select doc_id, "start"::bigint as "start", "end"::bigint as "end", md5(substr(restored, "start" + 1, "end" - "start")) as "to" from (select doc_id, restored, list_min(spots) as "start", list_max(spots) + 1 as "end" from (
    select r.doc_id, r.restored, list_filter(range(length(t.typed)), lambda i: substr(t.typed, i + 1, 1) <> substr(r.restored, i + 1, 1)) as spots from restored r join typed t using (doc_id)
    where length(t.typed) < 2000) where len(spots) > 0) union all select doc_id, -1, -1, 'long' from typed where length(typed) >= 2000""", "restored", "typed")
def edit_stretches(spark, d):
    """The least stretch of each text that the lexicon restorer rewrites; texts of 2,000 characters or more are named only, as in an editor."""
    out = R.LexiconRestorer(kept_lexicon(spark, d)).transform(typed(spark, d), id_col="doc_id", text_col="typed")
    short = out.where(F.length("typed") < 2000).select("doc_id", R.edit_stretch(F.col("typed"), F.col("restored")).alias("s")).where("s is not null")
    long = out.where(F.length("typed") >= 2000).select("doc_id", F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"), F.lit("long").alias("to"))
    return short.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.md5("s.to").alias("to")).unionByName(long)


# Evaluation


SYSTEMS = f"""made as materialized (select t.doc_id, t.pos, t.expected, t.key, s.system, case system when 'identity' then {Q.strip('t.expected')} when 'lexicon' then t.produced
    else coalesce(c.out, t.produced) end as out from pair t cross join (select unnest(['identity', 'lexicon', 'context']) as system) s left join (
    select f.doc_id, f.pos, {Q.applied('w.word', 'c.form')} as out from feat f join cbest c on c.key = f.key and c.l = f.l and c.r = f.r join ttok w on w.doc_id = f.doc_id and w.pos = f.pos) c on c.doc_id = t.doc_id and c.pos = t.pos),
    sums as materialized (select system, count(*) as words, sum((expected = out)::int)::bigint as correct, sum((a.key is not null)::int)::bigint as ambiguous, sum((a.key is not null and expected = out)::int)::bigint as ambiguous_correct,
    sum(list_sum(list_transform(list_zip(string_split(expected, ''), string_split(out, '')), lambda x: (x[1] <> x[2])::int)))::bigint as wrong_chars from made m left join ambiguous a on a.key = m.key group by 1)"""


@query("""select system, words, correct, ambiguous, ambiguous_correct, chars, wrong_chars, round(correct / words, 4) as word_accuracy, round(ambiguous_correct / ambiguous, 4) as ambiguous_accuracy, round(wrong_chars / chars, 4) as character_error_rate
    from sums cross join (select sum(length(text))::bigint as chars from documents)""", "pair", "ambiguous", "feat", "cbest", "ttok", more=SYSTEMS)
def system_rates(spark, d):
    """Three systems over the same texts."""
    words, forms, sides, vocab = C.context_model(spark, d)
    line_up = [R.Identity(), R.LexiconRestorer(words), R.ContextRestorer(words, forms, ctx.prune(sides), vocab, vocab.count() + 3)]
    rows = scoring.compared(scoring.evaluate(docs(spark, d), line_up, words, id_col="doc_id", text_col="text", group_col="doc_id"))
    return rows.select("system", "words", "correct", "ambiguous", "ambiguous_correct", "chars", "wrong_chars", "word_accuracy", "ambiguous_accuracy", "character_error_rate")


NAMED = f"""names as materialized (select {Q.key('word')} as key, word, count(*) as n from (select unnest(regexp_extract_all(title, '{Q.WORD}')) as word from (select regexp_extract(html, '<title>([^<]*)', 1) as title from pages))
    where {Q.is_upper('substr(word, 1, 1)')} and regexp_matches({Q.key('word')}, '[cegiosu]') group by 1, 2),
    alone as materialized (select o.key, spelling, titles, coalesce(seen, 0) as seen from (select key, max(word) as spelling, sum(n) as titles from names group by key having count(*) = 1) o left join (select key, sum(n) as seen from lex group by key) s on s.key = o.key),
    caps as materialized (select expected, produced, count(*) as n, {Q.key('expected')} as key, {Q.strip('expected')} as typed from pair where pos > 0 and {Q.is_upper('substr(expected, 1, 1)')} and not {Q.capitals('expected')} group by 1, 2),
    cutnames as materialized (select r.expected, r.produced, r.n, c, a.spelling, a.seen from (select *, unnest(range(4, length(typed) + 1)) as c from caps where length(typed) >= 4) r join alone a on a.key = {Q.key('substr(r.typed, 1, c)')} where length(a.spelling) = c),
    proposals as materialized (select 'titles spell it one way' as rule, r.produced, r.expected, r.n, a.spelling as proposed from caps r join alone a on a.key = r.key
    union all select 'and training never saw the word', r.produced, r.expected, r.n, a.spelling from caps r join alone a on a.key = r.key where a.seen = 0
    union all select 'and it is in two titles', r.produced, r.expected, r.n, a.spelling from caps r join alone a on a.key = r.key where a.titles >= 2
    union all select 'a name and a suffix', produced, expected, n, max_by(spelling, c) || substr(produced, max(c) + 1) from cutnames group by produced, expected, n
    union all select 'and training never saw the name', produced, expected, n, max_by(spelling, c) || substr(produced, max(c) + 1) from cutnames where seen = 0 group by produced, expected, n)"""


@query("""select rule, sum(n)::bigint as changed, sum(case when produced <> expected and proposed = expected then n else 0 end)::bigint as fixed, sum(case when produced = expected then n else 0 end)::bigint as broken,
    sum(case when produced <> expected and proposed = expected then n when produced = expected then -n else 0 end)::bigint as net from proposals where proposed <> produced group by rule""", "pair", "lex", more=NAMED)
def name_rules(spark, d):
    words = kept_lexicon(spark, d)
    pairs = stored(analysis.capitalised(C.word_pairs(spark, d, words)))
    return analysis.name_rules(pairs, stored(analysis.title_names(C._titles(spark, d), title_col="title")), words)


# Spelling


SUSPECTED = f"""{C.ENDINGS}, {C.UNKNOWN_CUTS}, {C.EDITS},
    susp as materialized (select w.key, w.n from words w left join plaus p on p.key = w.key where w.n < 5 and length(w.key) >= 3 and p.key is null
    union all select distinct e.key, e.n from edits e join known k on k.key = e.e where k.n >= 100 * e.n)"""


@query("select key, n::bigint as n from susp", "alpha", "cuts", "known", more=SUSPECTED)
def suspicious_keys(spark, d):
    words, endings = vocabulary(spark, d)
    return spelling.suspicious(words, words, endings)


@query("""select s.key, a as "first", b as "second" from (select key, substr(key, 1, c) as a, substr(key, c + 1) as b from (select key, unnest(range(2, length(key) - 1)) as c from words where n < 5 and length(key) >= 4)) s
    join known x on x.key = s.a join known y on y.key = s.b""", "known")
def word_splits(spark, d):
    words, _ = vocabulary(spark, d)
    rows = spelling._splits(words.where("n < 5").select("key", F.col("key").alias("joined")), words.where("n >= 5"))
    return rows.select("key", "first", "second")


@query(f"""select count(*) as words, sum((s.key is not null and not ({Q.is_upper('substr(word, 1, 1)')} and not ((pos = 0 and not regexp_matches(gap, '\\S')) or regexp_matches(gap, '[.!?…]\\s*$'))))::int)::bigint as suspected,
    sum((length(t.key) >= 3 and k.key is null)::int)::bigint as not_in_list from (select *, {Q.key('word')} as key from (select unnest(range(len(gs))) as pos, unnest(list_concat(ws, [null])) as word, unnest(gs) as gap from (
    select regexp_extract_all(text, '{Q.WORD}') as ws, string_split_regex(text, '{Q.WORD}') as gs from documents)) where word is not null) t left join susp s on s.key = t.key left join known k on k.key = t.key""", "alpha", "cuts", "known", more=SUSPECTED)
def false_alarm_rates(spark, d):
    words, endings = vocabulary(spark, d)
    return spelling.false_alarms(docs(spark, d), words, endings, id_col="doc_id", text_col="text")


# Annotation, training, requests


@query(f"""select doc_id, sum(abs(case when l = -100 then 0 else l end))::bigint as marks, sum((l <> -100)::int)::bigint as decided from (
    select doc_id, unnest(list_transform(list_zip(string_split({Q.strip('text')}, ''), string_split(text, '')), lambda x: case when contains('{L.PLAIN}', x[1]) then (x[1] <> x[2])::int else -100 end)) as l from documents where text <> '') group by doc_id""")
def masked_pairs(spark, d):
    """Labels as the tagger's training sees them: marks, and how many letters were decided."""
    rows = docs(spark, d).where("text <> ''").select("doc_id", training.masked_labels(F.col("text")).alias("l"))
    marks = F.aggregate("l", F.lit(0), lambda a, x: a + F.when(x == training.IGNORED, 0).otherwise(x))
    return rows.select("doc_id", marks.cast("long").alias("marks"), F.size(F.filter("l", lambda x: x != training.IGNORED)).cast("long").alias("decided"))


@query("""with recursive ev as (select user_id, epoch(ts)::double as t, row_number() over (partition by user_id order by ts, event_id) as nth from events),
    run as (select user_id, nth, true as admitted, t as last, null::double as before from ev where nth = 1 union all
    select user_id, nth, ok, case when ok then t else last end, case when ok then last else before end from (
    select e.user_id, e.nth, e.t, r.last, r.before, (r.before is null or e.t - r.before > 21600) as ok from run r join ev e on e.user_id is not distinct from r.user_id and e.nth = r.nth + 1))
    select user_id, count(*) as requests, sum(admitted::int)::bigint as admitted from run group by user_id""")
def rate_limiter(spark, d):
    """Two requests in six hours: the last but one that was admitted decides."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    out = limited(rows, user_col="user_id", time_col="ts", id_col="event_id", allowance=2, window=6 * 3600.0)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if("admitted").alias("admitted"))


@query(f"select doc_id, case when rest = 0 then md5(text) end as correct from (select doc_id, text, doc_id % 3 as rest, {Q.strip('text')} as typed from documents)")
def annotated_answers(spark, d):
    """Answers to every document: the right text for a third of them, a refused one (another word) for the others."""
    rows = typed(spark, d).select("doc_id", "typed", F.col("typed").alias("suggestion"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("qqqzzzqqq").alias("answer"))
    return annotate.applied_answers(rows, id_col="doc_id").select("doc_id", F.md5("correct").alias("correct"))


@query(f"select doc_id, md5(translate(text, '{L.PLAIN}', '{L.ACCENTED}')) as marked, md5(text) as kept from documents")
def label_marks(spark, d):
    """Every foldable letter marked over what was typed, and nothing marked, by labels."""
    rows = docs(spark, d).select("doc_id", "text", L.characters(F.col("text")).alias("c"))
    every, none = F.transform("c", lambda x: F.lit(1)), F.transform("c", lambda x: F.lit(0))
    return rows.select("doc_id", F.md5(L.restore_with_labels(F.col("text"), every)).alias("marked"), F.md5(L.restore_with_labels(F.col("text"), none)).alias("kept"))


@query(f"""select out, count(*) as n from (select case when length(word) > 1 and {Q.is_upper('word')} then {Q.upper('l')} when {Q.is_upper('substr(word, 1, 1)')} then {Q.upper('substr(l, 1, 1)')} || {Q.lower('substr(l, 2)')}
    else {Q.lower('l')} end as out from near) group by out""", "near")
def words_in_case(spark, d):
    """The key of the word before, in the case of the word itself."""
    return C.near(spark, d).groupBy(L.in_case_of(F.col("word"), F.col("left")).alias("out")).agg(F.count(F.lit(1)).alias("n"))


# Reports


@query()
def error_shares(spark, d):
    words = kept_lexicon(spark, d)
    return analysis.kind_shares(analysis.error_kinds(C.word_pairs(spark, d, words), words))


SQL["error_shares"] = f"""with k as materialized ({SQL['error_kinds']}), s as (select sum(words) filter (where kind = 'lowercase' or kind = 'all capitals' or kind like 'capitalised, %') as w, max(errors) filter (where kind = 'all') as e from k)
    select kind, words, errors, round(words / w, 4) as share_of_words, round(coalesce(errors / nullif(e, 0), 0), 4) as share_of_errors, round(coalesce(errors / nullif(words, 0), 0), 4) as rate from k cross join s"""


@query(f"""select domain, system, words, correct, word_accuracy, round(word_accuracy - first_value(word_accuracy) over (partition by domain order by system = 'identity' desc), 4) as gain from (
    select lang as domain, system, count(*) as words, sum((expected = out)::int)::bigint as correct, round(sum((expected = out)::int) / count(*), 4) as word_accuracy from made join documents using (doc_id) group by 1, 2)""", "pair", "ambiguous", "feat", "cbest", "ttok", more=SYSTEMS)
def domain_rates(spark, d):
    """Three systems in every language's texts, and what each gains over the first."""
    words, forms, sides, vocab = C.context_model(spark, d)
    line_up = [R.Identity(), R.LexiconRestorer(words), R.ContextRestorer(words, forms, ctx.prune(sides), vocab, vocab.count() + 3)]
    rows = scoring.by_domain(scoring.evaluate(docs(spark, d), line_up, words, id_col="doc_id", text_col="text", group_col="lang"), "lang", first="identity")
    return rows.where("words > 0").select(F.col("lang").alias("domain"), "system", "words", "correct", "word_accuracy", F.col("word_accuracy_gain").alias("gain"))


@query(f"""select {Q.key('word')} as key, word, count(*) as n from (select unnest(regexp_extract_all(title, '{Q.WORD}')) as word from (select regexp_extract(html, '<title>([^<]*)', 1) as title from pages where {Q.split_name('page_id::varchar')} = 'train'))
    where {Q.is_upper('substr(word, 1, 1)')} and regexp_matches({Q.key('word')}, '[cegiosu]') group by 1, 2""")
def training_title_names(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return analysis.title_names(analysis.in_training(pages, id_col="page_id"), title_col="title")


@query("""select doc_id, md5(string_agg(gap || coalesce(case when start % 2 = 0 then word else out end, ''), '' order by pos)) as restored from (
    select *, sum(length(gap) + coalesce(length(word), 0)) over (partition by doc_id order by pos rows unbounded preceding) - coalesce(length(word), 0) as start from lexout) group by doc_id""", "lexout")
def changes_reverted(spark, d):
    """The lexicon restorer's texts without the changes that start at an even place."""
    found = stored(R.changed_words(C.lexicon_rows(spark, d, kept_lexicon(spark, d), ends=True), id_col="doc_id"))
    out = R.revert(found, typed(spark, d), found.where("start % 2 = 0"), id_col="doc_id", text_col="typed")
    return out.select("doc_id", F.md5("restored").alias("restored"))


# Chat


@query("""select conv_id, turn, role as author, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i = 1 or regexp_matches(x, '\\S')), ' ')) as text from conversations""")
def chat_import(spark, d):
    """All conversations as exported lines, read back as messages."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("nth", "part"))
    line = F.when(F.col("nth") == 0, F.concat(F.lit("1/2/24, 10:00 - "), "role", F.lit(": "), "part")).otherwise(F.col("part"))
    lines = rows.select("conv_id", (F.col("turn") * 1000000 + F.col("nth")).alias("pos"), line.alias("line"))
    back = chat.whatsapp_messages(lines, file_col="conv_id")
    return back.select("conv_id", F.floor(F.col("pos") / 1000000).alias("turn"), "author", F.md5("text").alias("text"))


@query(f"with {C.USABLE} select distinct line as text from lines l join conversations c using (conv_id, turn) where line is not null and role = 'user' and line not in (select line from lines l join conversations c using (conv_id, turn) where line is not null and role <> 'user')")
def fresh_lines(spark, d):
    """One author's lines that no other author has."""
    rows = C.messages(spark, d)
    known = chat.kept_lines(rows.where("author <> 'user'"), order=("conv_id", "turn"))
    return chat.kept_lines(rows.where("author = 'user'"), known, order=("conv_id", "turn")).select("text")


@query("select doc_id from typed where typed not in (select t.typed from typed t join documents using (doc_id) where source = 'src0')", "typed")
def pending_annotations(spark, d):
    """Texts that are not among those of the source that is done."""
    rows = typed(spark, d).select("doc_id", "typed")
    done = docs(spark, d).where("source = 'src0'").select(L.strip_diacritics(F.col("text")).alias("typed"))
    return annotate.pending(rows, done).select("doc_id")


@query()
def request_answers(spark, d):
    """Every text as a request of its source, one in five seconds admitted: status, answer and number of changes."""
    asked = typed(spark, d).join(docs(spark, d).select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("id"), F.col("typed").alias("text"), F.col("source").alias("user"), F.col("doc_id").cast("double").alias("time"))
    out = Engine(R.LexiconRestorer(kept_lexicon(spark, d))).requests(asked, allowance=1, window=5.0)
    return out.select("id", "status", F.md5("text").alias("text"), F.size("changes").alias("changes"))


SQL["request_answers"] = "with recursive " + Q.query("", "lexout", "restored").strip().removeprefix("with ") + """, ev as materialized (select doc_id, source, doc_id::double as t, row_number() over (partition by source order by doc_id) as nth from documents),
    run as (select doc_id, source, nth, true as admitted, t as last from ev where nth = 1 union all
    select e.doc_id, e.source, e.nth, e.t - r.last > 5, case when e.t - r.last > 5 then e.t else r.last end from run r join ev e on e.source = r.source and e.nth = r.nth + 1),
    changed as (select doc_id, count(*) as n from lexout where word <> out group by 1)
    select r.doc_id as id, case when not admitted then 429 when length(restored) <= 10000 then 200 else 422 end as status, case when admitted and length(restored) <= 10000 then md5(restored) end as text,
    case when admitted and length(restored) <= 10000 then coalesce(n, 0) else 0 end::int as changes from run r join restored using (doc_id) left join changed using (doc_id)"""
