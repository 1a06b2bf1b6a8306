"""Tests of URLs, names, contacts and page texts as boolean columns; null in, null out unless said otherwise."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.constants import DATE_LIKE, EMAIL_PATTERN, INVALID_WORDS, PHONE_PATTERN, SOCIAL_PATTERN
from weftgraph.functions.urls import host, path, source_tag

#: Parts of addresses of pages that act rather than tell.
ACTION_WORDS = [
    "edit", "editar", "modifier", "bearbeiten", "modificare", "modifica", "editare", "editeaza", "editează",
    "login", "log-in", "log_in", "signin", "sign-in", "sign_in", "autentificare", "authentification", "authentication", "auth", "conectare", "logare", "inloggen", "anmelden", "connexion", "iniciar", "acceder", "entrar",
    "logout", "log-out", "log_out", "signout", "sign-out", "sign_out", "deconectare", "iesire", "ieșire",
    "register", "signup", "sign-up", "sign_up", "inregistrare", "înregistrare", "inscriere", "înscriere", "registrar",
    "account", "cont", "profile", "profil", "user", "utilizator", "settings", "setari", "setări", "preferences", "preferinte", "preferințe",
    "add", "create", "delete", "remove", "update", "modify", "submit", "post", "upload", "adauga", "adaugă", "sterge", "șterge", "actualizeaza", "actualizează",
    "share", "comment", "reply", "partajeaza", "partajează", "comentariu", "raspunde", "răspunde",
    "action=", "do=", "cmd=", "mode=edit", "mode=add", "mode=login", "veaction=edit", "section=", "special:", "especial:", "spezial:",
]
#: Suffixes that are read, and those that are not.
READ_SUFFIXES = [".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".png", ".jpg", ".jpeg", ".gif", ".bmp"]
SKIPPED_SUFFIXES = [".svg", ".webp", ".ico", ".tiff", ".tif"]
FILE_PAGES = ["/file:", "/image:", "/special:filepath", "/special:upload"]
#: What error pages say in their title and at their start.
ERROR_TITLES = ["404", "not found", "page not found", "403", "forbidden", "access denied", "500", "internal server error", "server error", "error", "unavailable", "does not exist", "pagina nu a fost gasita", "pagină negăsită", "eroare 404"]
ERROR_TEXTS = ["404 - page not found", "error 404", "404 not found", "the page you are looking for", "this page does not exist", "page cannot be found", "pagina nu poate fi gasita", "aceasta pagina nu exista"]
#: Patterns of copied encyclopedia text, and stop phrases of searches.
COPIED = [r"Reference This article used a translation", r"↑\s+[A-Z]+,\s+[A-Z]", r"\(\s*Romanian\s*\)\s*-\s*↑", r"Jump to:\s*a\s+b\s+c", r"^\s*\(\s*[A-Z]{2}\s*\)"]
ROBOT_CHECKS = ["recaptcha", "captcha", "i'm not a robot", "unusual traffic"]


def _any(text: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words, as one alternation: a chain of tests would make the generated code too long to compile."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def is_email(value: Column) -> Column:
    return value.rlike(f"^(?:{EMAIL_PATTERN})$")


def is_profile(value: Column) -> Column:
    return value.rlike(f"^(?:{SOCIAL_PATTERN})$")


def is_phone(value: Column) -> Column:
    """Written as a phone number with at least seven digits, and not as a date."""
    return value.rlike(rf"^(?:{PHONE_PATTERN})$") & (F.length(F.regexp_replace(value, r"\D", "")) >= 7) & ~value.rlike(DATE_LIKE)


def is_contact(value: Column) -> Column:
    v = F.trim(value)
    return is_email(v) | is_profile(v) | is_phone(v)


def is_entity_text(text: Column) -> Column:
    """A name: two characters, at most eight words, not stop words alone, no sentence marks, not marks or a number alone."""
    words = F.split(F.lower(F.trim(text)), r"\s+")
    return (
        (F.length(F.trim(text)) >= 2) & (F.size(words) <= 8) & ~F.forall(words, lambda w: w.isin(*INVALID_WORDS)) & ~text.rlike(r"[?!]|\.\.\.") & text.rlike(r"[\p{L}\p{N}_]") & ~F.trim(text).rlike(r"^[\d\s.,%-]+$")
    )


def crawlable(url: Column, whole_words: bool = False) -> Column:
    """A web address worth reading: documents and raster images always, other pages unless a part of the path or query acts or the page is a bare year.

    The words are looked for anywhere, so ``cont`` refuses /contact; with ``whole_words`` only words between marks count.
    """
    low, p = F.lower(url), F.lower(path(url))
    suffix = F.regexp_extract(p, r"(\.[^./]*)$", 1)
    rest = F.concat(p, F.lit("?"), F.regexp_extract(low, r"\?([^#]*)", 1))
    if whole_words:
        acts = F.arrays_overlap(F.split(rest, r"[/?&._-]"), F.array(*[F.lit(w) for w in ACTION_WORDS])) | _any(rest, [w for w in ACTION_WORDS if w[-1] in "=:"])
    else:
        acts = _any(rest, ACTION_WORDS)
    year = F.exists(F.split(p, "/"), lambda x: x.rlike(r"^(year[_-]?)?\d{4}$"))
    page = ~suffix.isin(*SKIPPED_SUFFIXES) & ~_any(low, FILE_PAGES) & ~acts & ~year
    return url.rlike("^(?i)https?://[^/?#]") & (suffix.isin(*READ_SUFFIXES) | page)


def valid_http(url: Column) -> Column:
    """A web address of plain characters, without traces of a local path, with a dotted host of at most 253 characters."""
    net = F.regexp_extract(url, "^https?://([^/?#]*)", 1)
    clean = url.rlike(r"^https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+$") & ~_any(url, ["file:///", "C:\\", "D:\\", "E:\\", "\\\\", "%7C"])
    return clean & F.contains(net, F.lit(".")) & (F.length(net) <= 253)


def real_url(url: Column) -> Column:
    """The web address inside a malformed one (after a pipe, in a local path, after a blank, anywhere), else the address as it is."""
    decoded = F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    decoded = F.coalesce(decoded, url)

    def found(source: Column, pattern: str) -> Column:
        x = F.regexp_extract(source, pattern, 1)
        return F.when(valid_http(x), x)

    plain = url.rlike("^https?://") & ~_any(url, ["file:///", "%7C", "|", "C:\\", "D:\\"])
    inside = r"""(https?://[^\s'"<>|]+)"""
    return F.when(plain, url).otherwise(
        F.coalesce(
            found(url, r"\|(https?://[^\s|]+)"),
            found(url, r"%7[Cc](https?://[^\s|]+)"),
            F.when(F.contains(F.lower(decoded), F.lit("file:///")) | url.rlike(r"^[A-Za-z]:\\"), found(decoded, inside)),
            found(decoded, r"[\s%20](https?://[^\s|]+)"),
            found(decoded, r"(https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+)"),
            url,
        )
    )


def site_listed(url: Column, tokens: list[str]) -> Column:
    """Whether a site of the list is the address' host, a parent of it, or its tag; false for an empty list."""
    h = host(url)
    hits = [(h == F.lit(t)) | h.endswith(F.lit("." + t)) | F.contains(F.concat(F.lit("."), h, F.lit(".")), F.lit(f".{t}.")) | (source_tag(url) == F.lit(t)) for t in tokens]
    return F.coalesce(reduce(or_, hits), F.lit(False)) if hits else F.lit(False)


def error_page(title: Column, body: Column) -> Column:
    """An error page by its title, the first 500 characters of its text, or a text of fewer than 100; nulls are no evidence."""
    t, start = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 500))
    n = F.length(F.trim(F.coalesce(body, F.lit(""))))
    return _any(t, ERROR_TITLES) | _any(start, ERROR_TEXTS) | ((F.length(F.coalesce(body, F.lit(""))) > 0) & (n < 100))


def copied_text(sentence: Column) -> Column:
    """Whether a sentence looks copied from an encyclopedia."""
    return reduce(or_, [sentence.rlike("(?i)" + p) for p in COPIED])


def robot_check(text: Column) -> Column:
    return _any(F.lower(text), ROBOT_CHECKS)


def whole_words(text: Column, terms: list[str]) -> Column:
    """Whether all terms stand in a text as whole words."""
    low = F.lower(text)
    return reduce(lambda a, b: a & b, [low.rlike(rf"(?<![0-9a-zA-Z])\Q{t.lower()}\E(?![0-9a-zA-Z])") for t in terms], F.lit(True))
