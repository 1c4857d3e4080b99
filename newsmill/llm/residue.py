"""Problem 2: template residue and error-page text.

Records made from one template are aligned by their sentences: names, figures and anything written like a variable are
slots, the words between them the template.  A slot that other records fill differently is an induced one; a record
that leaves a variable's name, a default or a blank in it is flagged, also where no list knows the name's spelling and
where nothing is left but the gap (both only by what other records have in the same place).  Whole fields made of such values are flagged
as well, and so are whole-page templates: short fields that come again, but for numbers and codes, from several
sources (error messages, notices about scripts, filler).  Messages that are rare are known by how they begin.

What stands in quotation marks is reported, not residue; a message inside a longer text is reporting, too, since only
whole fields are messages.

Python sees each field once and sends on hashes of templates, which are counted with map-side combine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, small_join, table

#: Characters up to which a whole field that comes from several sources is a page template whatever it says (a longer one
#: may be a syndicated article and must begin like a message), and the sources that it must come from.
PAGE, SOURCES = 400, 3
#: Sentences of so many words that don't begin like a message are ordinary ones; a long message has at most so many.
ORDINARY_WORDS, ORDINARY = 8, 3
#: Share of pseudo-Latin words that makes a field filler, and the least words.
FILLER, FILLER_WORDS = 0.6, 4
#: Ways to write a variable (fixed values).
VARIABLES = [
    r"\{\{\{?[^{}\n]{1,80}\}?\}\}", r"[$#]\{[^{}\n]{1,80}\}", r"\{[$%#][^{}\n]{1,80}\}", r"\{\d{1,2}\}", r"\{[A-Za-z_][\w.]{0,40}(?::[\w.]{0,20})?\}",
    r"<%.{1,80}?%>", r"<\?.{1,80}?\?>", r"<!--.{0,120}?-->", r"%%[A-Za-z_]\w{0,40}%%", r"%\([A-Za-z_]\w{0,40}\)[sdif]", r"\b__[A-Z][A-Z0-9_]{1,40}__\b",
    r"\*\|[A-Z][A-Z0-9_:]{0,40}\|\*", r"@Model\.\w{1,40}", r"@@\w{1,40}@@", r"##[A-Z_]{2,40}##", r"\[\[[^\[\]\n]{1,60}\]\]", r"\$[A-Z][A-Z_]{2,40}\$?",
    r"<[A-Z][A-Z_ ]{2,40}>", r"\bundefined undefined\b", r"\[object Object\]",
]
#: Defaults that editors leave where copy should go (fixed values).
DEFAULTS = [
    r"\bTK(?:TK)+\b", r"\bX{4,}\b", r"\[(?=[^\[\]\n]{3,60}\])[^\[\]\n]*\b(?i:here|insert|goes|follows?|tk|tbc|tbd|placeholder|byline|headline|caption|name|title|hier|einfügen|ici|insérer|aquí|insertar|aqui|inserir|ide|helye|tutaj|wstaw|siia|тук|εδώ)\b[^\[\]\n]*\]",
]
#: Stems of the usual filler text (fixed values).
FILLER_STEMS = "lorem ipsum dolor sit amet consect adipis elit sed eius tempor incid labor magna aliqu enim minim veniam quis nostr exerc ullam nisi commod conseq aute irur repreh volupt velit esse cill fugiat null pariat except sint occaec cupid proid culpa offic deser moll anim laborum ulla nisius".split()
#: How whole-field messages, notices and filler begin (fixed values), for those too rare to be repeated.
BEGINNINGS = [
    r"(?:error )?(?:40[0-9]|41[0-9]|42[0-9]|50[0-9])\b[ :–-]*(?:error|not found|forbidden|bad|service|gateway|internal|unauthorized|too many|gone|page|temporar)", r"(?:error|fehler|erreur|erro|hiba|błąd|viga|грешка|σφάλμα)\s*\d{3}",
    r"internal server error", r"bad gateway", r"gateway time-?out", r"service (?:temporarily )?unavailable", r"access denied", r"forbidden\b", r"permission denied", r"too many requests", r"page not found", r"not found\b",
    r"(?:oops|sorry)[,!].{0,40}(?:page|link|wrong|find)", r"something went wrong", r"error establishing", r"fatal error", r"\w*(?:Error|Exception): ", r"traceback \(most recent", r"warning: \w+\(", r"this site can[’']t be reached", r"this page isn[’']t",
    r"your session has expired", r"checking your browser", r"just a moment", r"please (?:turn on|enable|activate|switch on|wait)", r"you need to enable", r"(?:javascript|js|scripts?|cookies) (?:is|are|must|has|have|seems?)\b", r"(?:this (?:page|site|app)|the page) (?:requires|needs)", r"your browser", r"loading(?:…|\.\.\.)",
    r"enable javascript", r"(?:un)?supported browser", r"we(?:’|')re sorry, but", r"down for maintenance", r"(?:this )?site is (?:down|under)",
    r"seite nicht gefunden", r"zugriff verweigert", r"interner serverfehler", r"bitte (?:aktivieren|schalten|laden)", r"diese (?:anwendung|seite|website) (?:benötigt|erfordert|braucht)", r"ihr browser", r"es ist ein fehler",
    r"page introuvable", r"accès (?:refusé|interdit)", r"erreur interne", r"veuillez (?:activer|patienter)", r"votre navigateur", r"cette page (?:nécessite|requiert)", r"une erreur",
    r"página no encontrada", r"acceso denegado", r"error interno", r"(?:por favor,? )?active? javascript", r"(?:es necesario|debe) (?:activar|habilitar)", r"su navegador", r"esta página (?:necesita|requiere)",
    r"página não encontrada", r"acesso negado", r"erro interno", r"(?:por favor,? )?ative o javascript", r"seu navegador|o seu navegador", r"esta página (?:precisa|requer)",
    r"(?:a keresett )?oldal nem található", r"az oldal (?:megtekintéséhez|nem|karbantartás)", r"hiba történt", r"hozzáférés megtagadva", r"a tartalom betöltéséhez", r"kérjük, (?:engedélyezze|kapcsolja)", r"a böngészője",
    r"nie znaleziono strony|strona nie", r"odmowa dostępu|dostęp zabroniony", r"wystąpił błąd", r"włącz (?:obsługę )?javascript", r"lehte ei leitud", r"ligipääs keelatud", r"lubage javascript", r"страницата не", r"достъпът е", r"моля,? (?:включете|активирайте)", r"възникна грешка", r"η σελίδα δεν", r"δεν επιτρέπεται", r"ενεργοποιήστε", r"παρουσιάστηκε σφάλμα",
    r"ページが見つかりません", r"アクセスが拒否", r"javascriptを有効", r"エラーが発生", r"サーバー", r"お使いのブラウザ",
    r"(?:your|sample|dummy|placeholder|body|article) (?:text|copy|body|paragraph)\b.{0,60}(?:here|replace|publish|goes|signed|dummy)", r"placeholder\b", r"this is (?:sample|dummy|placeholder|test)", r"text text\b", r"test test\b", r"abc 123", r"asdf", r"\[body copy", r"(?:tbc|tbd|todo|tk)\W*$", r"hier steht", r"ide jön", r"(?:ici|aquí|aqui) (?:va|vient|el texto|o texto)", r"texte? (?:à venir|de exemplo|de ejemplo|d’exemple)", r"beispieltext|blindtext|mintaszöveg",
]

_VARIABLE = regex.compile("|".join(VARIABLES + DEFAULTS))
_MAYBE = regex.compile(r"[{}\[%_*@#$<]|TK|XX|undefined")
_QUOTED = regex.compile(r"“[^“”\n]*+”|„[^„“”\n]*+[“”]|«[^«»\n]*+»|»[^«»\n]*+«|\"[^\"\n]*+\"|‘[^‘\n]*?’(?!\p{L})|「[^」\n]*+」")
_BEGIN = regex.compile("(?:" + "|".join(BEGINNINGS) + ")", regex.IGNORECASE)
_WORDS = regex.compile(r"\p{L}+")
_STEM = regex.compile(r"(?:" + "|".join(sorted(FILLER_STEMS, key=len, reverse=True)) + ")")
#: Numbers, hexadecimal codes and single words in brackets that messages carry to tell one case from another.
_TAG = regex.compile(r"\s*\[[\w-]{4,40}\]")
_CODE = regex.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+")
_SLOT = regex.compile(r"\p{Lu}\p{Ll}[\p{L}\p{M}’'\-]*+(?:[ \-]+\p{Lu}\p{Ll}[\p{L}\p{M}’'\-]*+)*|\d+")
#: Names of variables without any mark around, and lines or question marks to be filled in: residue in an induced slot only.
_ODD = regex.compile(r"(?<![\w@#/.:&=?-])(?:[A-Za-z]+(?:_[A-Za-z0-9]+)+|_{3,}|\?{3,})(?![\w@/=]|\.\w)")
_MAYBE_ODD = regex.compile(r"_|\?{3}")
_SENTENCES = regex.compile(r"(?<=[.!?。])\s+|\n+|\s+–\s+(?=–|\p{Lu})")


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def unquoted(text: str) -> str:
    return _QUOTED.sub(" “” ", text)


def residues(text: str) -> list[str]:
    """Variables and defaults in a text, outside quotation marks."""
    if not _MAYBE.search(text) or not _VARIABLE.search(text):
        return []
    return [m[0] for m in _VARIABLE.finditer(unquoted(text))]


def _template(left: str) -> str | None:
    """A sentence with slots ▢ for names, figures and what was taken out (\x00), if it has a slot and two words."""
    shape = _SLOT.sub("▢", left)
    if "\x00" in left:
        shape = regex.sub(r"[\x00▢](?:[\s,]*[\x00▢])*", "▢", shape)
    return " ".join(shape.split()).lower() if "▢" in shape and len(_WORDS.findall(shape)) >= 2 else None


def templates(text: str) -> list[tuple[str, str, str | None]]:
    """(template, kind, gap) of the sentences that hold a slot.  ``kind``: ``left`` (a slot holds residue), ``odd`` (it
    holds what may be residue) or ``filled``; ``gap`` is a ``left`` sentence's template with nothing in its place, if words
    stand on both sides of it."""
    out = []
    for s in _SENTENCES.split(unquoted(text) if _MAYBE.search(text) else text):
        if not s:
            continue
        left = _VARIABLE.sub("\x00", s) if _MAYBE.search(s) else s
        if t := _template(left):
            gap = None
            if "\x00" in left and _WORDS.search(left[: left.index("\x00")]) and _WORDS.search(left[left.rindex("\x00") :]):
                gap = _template(left.replace("\x00", " "))
            out.append((t, "left" if "\x00" in left else "filled", gap))
        if "\x00" not in left and _MAYBE_ODD.search(s) and _ODD.search(s) and (t := _template(_ODD.sub("\x00", unquoted(s)))):
            out.append((t, "odd", None))
    return out


def page_template(text: str) -> str | None:
    """A short field but for numbers and codes, in lower case."""
    t = " ".join(_TAG.sub("", text).split())
    return _CODE.sub("0", t.lower()) if t and (len(t) <= PAGE or is_message(text)) else None


def is_filler(text: str) -> bool:
    """Pseudo-Latin, or one word again and again."""
    words = _WORDS.findall(_TAG.sub("", text).lower())
    stems: dict[str, bool] = {}
    for w in words:
        if w not in stems:
            stems[w] = bool(_STEM.match(w))
    if len(words) >= FILLER_WORDS and sum(stems[w] for w in words) >= FILLER * len(words):
        return True
    return len(words) >= 3 and len(stems) == 1


def is_message(text: str) -> bool:
    """A field that begins like a message, notice or filler and doesn't go on with an article."""
    t = " ".join(_TAG.sub("", text).split())
    if not _BEGIN.match(t):
        return False
    if len(t) <= PAGE:
        return True
    ordinary = 0
    for s in _SENTENCES.split(t):
        ordinary += len(s.split()) >= ORDINARY_WORDS and not _BEGIN.match(s)
        if ordinary > ORDINARY:
            return False
    return True


_OUT = ["page", "residue", "bare", "filler", "message", "slots", "filled", "odd", "gaps"]
_DDL = "page bigint, residue boolean, bare boolean, filler boolean, message boolean, slots array<bigint>, filled array<bigint>, odd array<bigint>, gaps array<array<bigint>>"


def _look(text: str) -> tuple:
    found = residues(text)
    page = page_template(text)
    forms = templates(text)
    bare = bool(found) and not _WORDS.search(_VARIABLE.sub(" ", unquoted(text)))
    return (
        _hash(page) if page and not found else None, bool(found), bare, is_filler(text), is_message(text),
        *(list({_hash(t) for t, kind, _ in forms if kind == k}) for k in ("left", "filled", "odd")),
        [[_hash(gap), _hash(t)] for t, _, gap in forms if gap],
    )


def inspect(pages: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(key, field_name, why) of the fields that hold residue or consist of filler, a message or a notice.

    ``why``: ``slot`` (residue or nothing in a slot that other records fill), ``variable`` (residue elsewhere), ``filler``,
    ``page`` (a repeated whole page) or ``message``.  Null, empty and blank fields are none; a row that comes twice is
    named twice; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.list_(pa.int64()))]
        for b in batches:
            got = list(zip(*map(_look, b.column(3).to_pylist()))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(list(v), k) for v, k in zip(got, kinds))], [key, "source", "field_name", *_OUT])

    kind = pages.schema[key].dataType.simpleString()
    both = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    rows = pages.select(F.col(key), F.col(source).alias("source"), F.explode(both).alias("f")).select(key, "source", "f.*").where("trim(text) <> ''")
    seen = cut(rows.mapInArrow(run, f"`{key}` {kind}, source string, field_name string, {_DDL}"))
    # Induced slots: templates that some record left residue in and others fill.
    at = lambda c: seen.where(F.size(c) > 0).select(key, "field_name", F.explode(c).alias("t"))
    open_, odd = at("slots"), at("odd")
    gaps = seen.where(F.size("gaps") > 0).select(F.explode("gaps").alias("g")).select(F.col("g")[0].alias("gap"), F.col("g")[1].alias("t")).distinct()
    wanted = open_.select("t").unionByName(odd.select("t")).unionByName(gaps.select(F.col("gap").alias("t"))).distinct()
    filled = cut(seen.where(F.size("filled") > 0).select(F.explode("filled").alias("t")).groupBy("t").agg(F.count("*").alias("n")).join(wanted, "t", "left_semi"))
    others = open_.groupBy("t").agg(F.count("*").alias("n"))
    induced = filled.select("t").unionByName(others.where("n > 1").select("t")).distinct()
    slot = open_.join(induced, "t", "left_semi")
    # What no list knows stands where others have residue, or where enough records have a name or figure.
    sure = others.select("t").unionByName(filled.where(F.col("n") >= SOURCES).select("t")).distinct()
    slot = slot.unionByName(odd.join(sure, "t", "left_semi"))
    # A gap is one if enough records have something in its place, and more than have nothing.
    support = others.unionByName(filled).groupBy("t").agg(F.sum("n").alias("support")).where(F.col("support") >= SOURCES)
    blank = gaps.join(support, "t").join(filled.select(F.col("t").alias("gap"), "n"), "gap").where("n < support").select(F.col("gap").alias("t")).distinct()
    slot = slot.unionByName(small_join(at("filled"), blank, ["t"], key, "left_semi"))
    slot = slot.select(key, "field_name").distinct().withColumn("slot", F.lit(True))
    # Whole pages that come again from several sources.
    again = seen.where("page is not null").groupBy("page", "source").agg(F.count("*").alias("n")).groupBy("page").agg(F.count("*").alias("sources")).where(F.col("sources") >= SOURCES)
    c = F.col
    told = small_join(seen.drop("slots", "filled", "source").join(slot, [key, "field_name"], "left"), again, ["page"], key)
    # The method's own findings come first, fixed lists last.
    why = F.when(c("slot"), "slot").when(c("sources").isNotNull(), "page").when(c("residue") | c("bare"), "variable").when(c("filler"), "filler").when(c("message"), "message")
    return told.select(key, "field_name", why.alias("why")).where("why is not null")


def p2_inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(table(spark, sf_dir, "article_extractions"), "extraction_id", "source_id", ["body_text", "excerpt"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_inspected(spark, sf_dir).select("extraction_id", "field_name")
