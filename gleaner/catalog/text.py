"""Text extraction, scalars and quality: catalogue entries with check SQL."""

from pyspark.sql import functions as F

from gleaner.catalog.registry import query
from gleaner.catalog.search import TOK
from gleaner.functions import textcols as X
from gleaner.operators import text as C


def lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


@query("c01_detect_pii", "SELECT * FROM (SELECT doc_id, " + ", ".join(
    f"len(regexp_extract_all(text,{lit(p)})) AS n_{n}" for n, p in X.PII.items())
    + " FROM documents) WHERE " + "+".join(f"n_{n}" for n in X.PII) + ">0")
def _(t):
    return C.detect_pii(t.documents, "doc_id", "text")


_red = "text"
for _n in ("email", "phone", "ip", "card"):
    _red = f"regexp_replace({_red},{lit(X.PII[_n])},'[{_n}]','g')"


@query("c02_redact_pii", f"""SELECT doc_id, md5(r) AS redacted_md5, length(r) AS chars FROM (
 SELECT doc_id, text, {_red} AS r FROM documents) WHERE r<>text""")
def _(t):
    return C.redact_pii(t.documents, "text").select(
        "doc_id", F.md5("redacted").alias("redacted_md5"), F.length("redacted").alias("chars"))


DATED = """concat(text, ' 2024-', lpad(cast(doc_id%14 as string),2,'0'), '-', lpad(cast(doc_id%31 as string),2,'0'),
 ' $', cast(doc_id%500 as string), '.99 or €1,', cast(100+doc_id%900 as string), '.50')"""


@query("c03_extract_dates_prices", f"""WITH d AS (SELECT doc_id, {DATED.replace('string', 'varchar')} AS text FROM documents)
 SELECT doc_id, 'date' AS kind, raw AS on_date, cast(NULL as double) AS amount, cast(NULL as varchar) AS currency, raw FROM (
  SELECT doc_id, unnest(regexp_extract_all(text,{lit(X.ISO_DATE)})) AS raw FROM d) WHERE try_cast(raw as date) IS NOT NULL
 UNION ALL SELECT doc_id, 'price', NULL, R4(cast(replace(substr(raw,2),',','') as double)), left(raw,1), raw FROM (
  SELECT doc_id, unnest(regexp_extract_all(text,{lit(X.MONEY)})) AS raw FROM d)""")
def _(t):
    return C.extract_dates_prices(t.documents.withColumn("text", F.expr(DATED)), "doc_id", "text")


@query("c04_extract_urls", f"""SELECT page_id, i-1 AS "at", u[i] AS url FROM (SELECT page_id, u,
 unnest(generate_series(1,len(u))) AS i FROM (SELECT page_id,
 regexp_extract_all(concat('see ',url,' and http://site',cast(page_id%9 as varchar),'.example.org/a ',html),{lit(X.URL)}) AS u FROM pages))""")
def _(t):
    text = F.expr("concat('see ',url,' and http://site',cast(page_id%9 as string),'.example.org/a ',html)")
    return C.extract_urls(t.pages.withColumn("t", text), "page_id", "t")


TAGGED = "concat(text,' #Tag',cast(doc_id%7 as string),' by @acct',cast(doc_id%5 as string))"


@query("c05_extract_tags", rf"""SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(
 lower({TAGGED.replace('string', 'varchar')}),'[#@][\p{{L}}\p{{N}}_]+')) AS tag FROM documents) GROUP BY 1""")
def _(t):
    return C.extract_tags(t.documents.withColumn("t", F.expr(TAGGED)), "t")


TIMED = "concat(text,' at ',cast(turn%3 as string),':',lpad(cast(conv_id%60 as string),2,'0'),':07 or 4:',lpad(cast(turn%60 as string),2,'0'))"


@query("c06_extract_timecodes", f"""WITH m AS (SELECT conv_id, turn, regexp_extract_all({TIMED.replace('string', 'varchar')},{lit(X.TIMECODE)}) AS m FROM conversations),
 r AS (SELECT conv_id, turn, m, unnest(generate_series(1,len(m))) AS i FROM m)
 SELECT conv_id, turn, i-1 AS "at", m[i] AS mark,
 cast(list_reduce(list_transform(string_split(m[i],':'), lambda x: cast(x as bigint)), lambda a, b: a*60+b) as bigint) AS second FROM r""")
def _(t):
    return C.extract_timecodes(t.conversations.withColumn("t", F.expr(TIMED)), ["conv_id", "turn"], "t")


@query("c07_scan_secrets", f"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text,{lit(X.SECRET)},1)) AS s FROM documents)
 SELECT doc_id, concat(left(s,4),'****') AS masked, length(s) AS chars,
 R4(-list_sum(list_transform(list_distinct(string_split(s,'')), lambda c:
  (len(list_filter(string_split(s,''), lambda x: x=c))/length(s))*log2(len(list_filter(string_split(s,''), lambda x: x=c))/length(s))))) AS bits FROM s""")
def _(t):
    return C.scan_secrets(t.documents, "doc_id", "text")


@query("c08_validate_luhn", r"""WITH n AS (SELECT lang, unnest(regexp_extract_all(text,'\b[0-9]{16}\b')) AS num FROM documents),
 c AS (SELECT lang, list_sum(list_transform(generate_series(1,16), lambda i:
  CASE WHEN i%2=1 THEN (CASE WHEN cast(num[i] as int)*2>9 THEN cast(num[i] as int)*2-9 ELSE cast(num[i] as int)*2 END)
  ELSE cast(num[i] as int) END))%10=0 AS ok FROM n)
 SELECT lang, count(*) AS numbers, count(*) FILTER (ok) AS passed, R4(count(*) FILTER (ok)/count(*)) AS rate FROM c GROUP BY 1""")
def _(t):
    return C.validate_luhn(t.documents, "lang", "text")


@query("c09_validate_mod97", """WITH b AS (SELECT c_mktsegment, c_custkey, lpad(cast(c_custkey*7919 as varchar),12,'0') AS body FROM customer),
 k AS (SELECT *, 98-cast(concat(body,'263500') as bigint)%97 AS good FROM b),
 v AS (SELECT c_mktsegment, body, CASE WHEN c_custkey%4=0 THEN (good+1)%100 ELSE good END AS cd FROM k)
 SELECT c_mktsegment, count(*) AS codes, count(*) FILTER (ok) AS passed, R4(count(*) FILTER (ok)/count(*)) AS rate FROM (
 SELECT c_mktsegment, cast(concat(body,'2635',lpad(cast(cd as varchar),2,'0')) as bigint)%97=1 AS ok FROM v) GROUP BY 1""")
def _(t):
    body = F.lpad((F.col("c_custkey") * 7919).cast("string"), 12, "0")
    good = 98 - F.concat(body, F.lit("263500")).cast("bigint") % 97
    cd = F.when(F.col("c_custkey") % 4 == 0, (good + 1) % 100).otherwise(good)
    code = F.concat(F.lit("QZ"), F.lpad(cd.cast("string"), 2, "0"), body)
    return C.validate_mod97(t.customer.withColumn("code", code), "c_mktsegment", "code")


@query("c10_validate_contact_syntax", rf"""WITH d AS (SELECT lang, regexp_extract_all(text,'[^ \n]+@[^ \n]+') AS ms,
 list_transform(regexp_extract_all(text,'\+[0-9 ()-]+'), lambda x: concat('+',regexp_replace(x,'[^0-9]','','g'))) AS ps FROM documents),
 c AS (SELECT lang, ms[i] AS m, ps[i] AS p FROM d, unnest(range(1, greatest(coalesce(len(ms),0),coalesce(len(ps),0),1)+1)) u(i)),
 s AS (SELECT lang, cast(coalesce(regexp_matches(m,'^{X.EMAIL}$'),false) as int) AS gm,
 cast(coalesce(regexp_matches(p,'^\+[1-9][0-9]{{6,14}}$'),false) as int) AS gp FROM c)
 SELECT lang, count(*) AS n, R4(avg(gm)) AS mail_share, R4(avg(gp)) AS phone_share, R4(avg(6*gm+4*gp)) AS score FROM s GROUP BY 1""")
def _(t):
    mails = F.regexp_extract_all("text", F.lit(r"[^ \n]+@[^ \n]+"), F.lit(0))
    phones = F.transform(F.regexp_extract_all("text", F.lit(r"\+[0-9 ()-]+"), F.lit(0)),
                         lambda x: F.concat(F.lit("+"), F.regexp_replace(x, "[^0-9]", "")))
    pairs = F.explode_outer(F.arrays_zip(mails.alias("mail"), phones.alias("phone"))).alias("pair")
    return C.validate_contact_syntax(t.documents.select("lang", pairs).select("lang", "pair.*"), "lang", "mail", "phone")


@query("c11_hash_columns", """SELECT doc_id, md5(concat_ws('|',lang,text)) AS md5, sha1(concat_ws('|',lang,text)) AS sha1,
 sha256(concat_ws('|',lang,text)) AS sha256 FROM documents""")
def _(t):
    return C.hash_columns(t.documents, "doc_id", ["lang", "text"]).drop("crc32")


@query("c11_digest_groups", """SELECT sha256(concat_ws('|',lang,text)) AS sha256, count(*) AS rows, min(doc_id) AS first, max(doc_id) AS last
 FROM documents GROUP BY 1 HAVING count(*)>1""")
def _(t):
    return C.digest_groups(t.documents, "doc_id", ["lang", "text"])


@query("c12_encode_decode", """SELECT lang, count(*) FILTER (doc_id%10=0) AS base64_failed, count(*) FILTER (doc_id%7=0) AS hex_failed,
 count(*) FILTER (doc_id%11=0) AS url_failed, cast(sum(CASE WHEN doc_id%10<>0 THEN strlen(text) ELSE 0 END) as bigint) AS base64_bytes,
 cast(sum(CASE WHEN doc_id%7<>0 THEN strlen(text) ELSE 0 END) as bigint) AS hex_bytes,
 cast(sum(CASE WHEN doc_id%11<>0 THEN length(text) ELSE 0 END) as bigint) AS url_chars FROM documents GROUP BY 1""")
def _(t):
    d = t.documents.select(
        "lang",
        F.when(F.col("doc_id") % 10 == 0, F.lit("*not base64*")).otherwise(C.encode_column(F.col("text"), "base64")).alias("b"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("xyz")).otherwise(C.encode_column(F.col("text"), "hex")).alias("h"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("%zz")).otherwise(C.encode_column(F.col("text"), "url")).alias("u"),
    )
    return C.decode_report(d, "lang", "b", "h", "u")


@query("c13_normalise_text", r"""SELECT doc_id, md5(lower(trim(regexp_replace(text,'[ \t\r\n]+',' ','g')))) AS digest,
 length(lower(trim(regexp_replace(text,'[ \t\r\n]+',' ','g')))) AS chars FROM documents""")
def _(t):
    clean = X.normalise(F.col("text"))
    return t.documents.select("doc_id", F.md5(clean).alias("digest"), F.length(clean).alias("chars"))


_vis = "html"
for _p in (r"(?s)<!--.*?-->", r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<[^>]*>"):
    _vis = f"regexp_replace({_vis},{lit(_p)},' ','g')"
for _e, _c in X.ENTITIES.items():
    _vis = f"replace({_vis},{lit(_e)},{lit(_c)})"
_vis = rf"trim(regexp_replace({_vis},'[ \t\r\n]+',' ','g'))"


@query("c14_html_to_text", f"SELECT page_id, {_vis} AS body FROM pages")
def _(t):
    return t.pages.select("page_id", X.visible_text(F.col("html")).alias("body"))


@query("c15_word_frequency", f"""SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({TOK}) AS word FROM documents)
 GROUP BY 1,2""")
def _(t):
    return C.word_frequency(t.documents, "text", ["lang"])


@query("c16_distinctive_terms", f"""WITH tf AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({TOK}) AS word FROM documents) GROUP BY 1,2),
 s AS (SELECT lang, word, n, n*ln((1+(SELECT count(distinct lang) FROM documents))/cast(count(*) OVER (PARTITION BY word) as double)) AS score FROM tf),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score,6) DESC, word) AS position FROM s)
 SELECT lang, word, n, R4(score) AS score, position FROM r WHERE position<=20""")
def _(t):
    return C.distinctive_terms(t.documents, "lang", "text", 20)


@query("c17_cooccurring_terms", f"""WITH d AS (SELECT doc_id, list_distinct({TOK}) AS w FROM documents),
 e AS (SELECT list_contains(w,'that') AS has, unnest(w) AS word FROM d),
 c AS (SELECT word, count(*) AS docs, count(*) FILTER (has) AS together FROM e GROUP BY 1)
 SELECT word, docs, together, R4(lift) AS lift FROM (SELECT *, together*(SELECT count(*) FROM d)/
 (docs*(SELECT count(*) FROM d WHERE list_contains(w,'that')))::double AS lift FROM c WHERE together>=5 AND word<>'that') x
 ORDER BY round(x.lift,9) DESC, word LIMIT 30""")
def _(t):
    return C.cooccurring_terms(t.documents, "text", "that", 5, 30)


NEWER = "concat(regexp_replace(text,'\\n[^\\n]*$',''), CASE WHEN doc_id%3=0 THEN '\n' ELSE '' END, 'last words ', cast(doc_id as string))"


@query("c18_text_diff", r"""WITH b AS (SELECT doc_id, concat(regexp_replace(text,'\n[^\n]*$',''), CASE WHEN doc_id%3=0 THEN chr(10) ELSE '' END, 'last words ', cast(doc_id as varchar)) AS text FROM documents),
 l AS (SELECT doc_id, unnest(string_split(text,chr(10))) AS line, 1 AS o, 0 AS n FROM documents
  UNION ALL SELECT doc_id, unnest(string_split(text,chr(10))), 0, 1 FROM b),
 g AS (SELECT doc_id, line, sum(o) AS o, sum(n) AS n FROM l GROUP BY 1,2)
 SELECT doc_id, cast(sum(greatest(n-o,0)) as bigint) AS added, cast(sum(greatest(o-n,0)) as bigint) AS removed,
 cast(sum(least(o,n)) as bigint) AS kept FROM g GROUP BY 1""")
def _(t):
    old = t.documents.select("doc_id", "text")
    new = old.select("doc_id", F.concat(
        F.regexp_replace("text", r"\n[^\n]*$", ""),
        F.when(F.col("doc_id") % 3 == 0, "\n").otherwise(""),
        F.lit("last words "), F.col("doc_id").cast("string")).alias("text"))
    return C.text_diff(old, new, ["doc_id"], "text")


@query("c19_summarise_extractive", rf"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(text,'[.!?][ \n]+'), lambda x: x<>'') AS ss FROM documents),
 q AS (SELECT doc_id, i-1 AS "at", ss[i] AS text FROM (SELECT doc_id, ss, unnest(generate_series(1,len(ss))) AS i FROM s)),
 w AS (SELECT word, count(*) AS docs FROM (SELECT unnest(list_distinct({TOK})) AS word FROM documents) GROUP BY 1),
 c AS (SELECT doc_id, "at", avg(ln(1.0::double+docs)) AS score FROM (SELECT doc_id, "at", unnest({TOK}) AS word FROM q) JOIN w USING (word) GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score,6) DESC, "at") AS position FROM c)
 SELECT r.doc_id, r.position, r."at", R4(r.score) AS score, q.text AS sentence FROM r JOIN q ON r.doc_id=q.doc_id AND r."at"=q."at" WHERE r.position<=2""")
def _(t):
    return C.summarise_extractive(t.documents, "doc_id", "text", 2)


@query("c20_near_duplicates", rf"""WITH w AS (SELECT doc_id, {TOK} AS w FROM documents),
 c AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY array_to_string(w,' ')) AS lead FROM w),
 g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w)<3 THEN [array_to_string(w,' ')] ELSE
  list_transform(generate_series(1,len(w)-2), lambda i: array_to_string(w[i:i+2],' ')) END) AS g FROM c WHERE doc_id=lead),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 o AS (SELECT b.doc_id, a.doc_id AS lead, count(*) AS both FROM g b JOIN g a ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
 j AS (SELECT o.doc_id, o.lead, o.both/cast(x.n+y.n-o.both as double) AS jaccard
  FROM o JOIN n x ON x.doc_id=o.doc_id JOIN n y ON y.doc_id=o.lead)
 SELECT doc_id, lead AS leader, 1.0::double AS jaccard FROM c WHERE doc_id<>lead
 UNION ALL SELECT doc_id, min(lead), R4(arg_min(jaccard, lead)) FROM j WHERE jaccard>=0.7 GROUP BY 1""")
def _(t):
    return C.near_duplicates(t.documents, "doc_id", "text", 0.7)


@query("c21_exact_duplicates", """SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS keep FROM documents
 GROUP BY 1 HAVING count(*)>1""")
def _(t):
    return C.exact_duplicates(t.documents, "doc_id", "text")


def _grams(table, key):
    """Six-word runs by lead over numbered words."""
    rest = "".join(f",' ',lead(word,{j}) OVER w" for j in range(1, 6))
    return f"""(SELECT * FROM (SELECT k, CASE WHEN lead(word,5) OVER w IS NOT NULL THEN concat(word{rest}) END AS gram
 FROM (SELECT {key} AS k, unnest({TOK}) AS word, generate_subscripts({TOK},1) AS pos FROM {table})
 WINDOW w AS (PARTITION BY k ORDER BY pos)) WHERE gram IS NOT NULL)"""


@query("c22_passage_reuse", f"""WITH p AS (SELECT DISTINCT gram FROM {_grams('benchmark', 'item_id')}),
 g AS (SELECT k AS doc_id, gram FROM {_grams('documents', 'doc_id')}),
 a AS (SELECT doc_id, count(*) AS grams, count(p.gram) AS reused FROM g LEFT JOIN p USING (gram) GROUP BY 1)
 SELECT doc_id, grams, reused, R4(reused/grams) AS share FROM a WHERE reused>0""")
def _(t):
    return C.passage_reuse(t.documents, "doc_id", "text", t.benchmark, "text", 6)


CLAUSES = {"licence": r"(?i)licen[sc]e", "copyright": r"(?i)copyright", "secret": r"(?i)token|secret|password",
           "contact": r"@[a-z0-9]+\."}


@query("c23_tag_clauses", "SELECT doc_id, labels FROM (SELECT doc_id, concat_ws('|'," + ",".join(
    f"CASE WHEN regexp_matches(text,{lit(p)}) THEN '{n}' END" for n, p in sorted(CLAUSES.items()))
    + ") AS labels FROM documents) WHERE labels<>''")
def _(t):
    return C.tag_clauses(t.documents, "doc_id", "text", CLAUSES)


@query("c24_cluster_texts")
def _(t):
    return C.cluster_texts(t.documents, "doc_id", "text", 4)


@query("c25_term_timeline", f"""SELECT strftime(timestamp '2024-01-01' + to_days(cast(doc_id%60 as int)),'%Y-%m-%d %H:%M:%S') AS "at", count(*) AS rows,
 count(*) FILTER (list_contains(toks,'that')) AS n_that, count(*) FILTER (list_contains(toks,'from')) AS n_from
 FROM (SELECT doc_id, {TOK} AS toks FROM documents) GROUP BY 1""")
def _(t):
    seen = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("doc_id") % 60).cast("int"))
    return C.term_timeline(t.documents.withColumn("seen", seen), "text", "seen", ["that", "from"], "day")


_lat = f"translate(lower(text),'{X.CYRILLIC + X.ACCENTED}','{X.CYRILLIC_LATIN + X.PLAIN}')"
for _e, _c in {**X.CYRILLIC_DIGRAPHS, **X.LIGATURES}.items():
    _lat = f"replace({_lat},'{_e}','{_c}')"


@query("c26_transliterate", f"SELECT doc_id, md5(r) AS digest, left(r,40) AS start FROM (SELECT doc_id, {_lat} AS r FROM documents)")
def _(t):
    return C.transliterate(t.documents, "text").select(
        "doc_id", F.md5("latin").alias("digest"), F.substring("latin", 1, 40).alias("start"))


_code = "translate(upper(w),'BFPVCGJKQSXZDTLMNRAEIOUYHW','11112222222233455600000099')"
_run = f"concat(left({_code},1),replace(substr({_code},2),'9',''))"
for _d in "123456":
    _run = f"regexp_replace({_run},'{_d}+','{_d}','g')"


@query("c27_phonetic_key", f"""SELECT key, count(*) AS rows, count(distinct p_name) AS variants, min(p_name) AS first_name,
 max(p_name) AS last_name, levenshtein(min(p_name),max(p_name)) AS spread FROM (
 SELECT p_name, concat(upper(left(w,1)),left(rpad(replace(substr({_run},2),'0',''),3,'0'),3)) AS key FROM (
 SELECT p_name, string_split(p_name,' ')[-1] AS w FROM part)) GROUP BY 1""")
def _(t):
    return C.phonetic_key(t.part, "p_name")


@query("c28_compare_languages", "SELECT source, " + ", ".join(
    f"count(*) FILTER (lang='{x}') AS n_{x}, R4(coalesce(avg(n_chars) FILTER (lang='{x}'),0)) AS size_{x}"
    for x in ("en", "fr", "de", "es")) + " FROM documents GROUP BY 1")
def _(t):
    return C.compare_languages(t.documents, "source", "lang", ["en", "fr", "de", "es"], "n_chars")


@query("c29_id_timestamp", """SELECT strftime(date_trunc('hour',ts),'%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    ids = t.events.select(
        (F.shiftleft(F.unix_seconds(F.col("ts").cast("timestamp")), 32) + F.col("event_id")).alias("id"))
    return C.id_timestamp(ids, "id")
