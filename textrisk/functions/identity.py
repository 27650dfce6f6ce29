"""Author and community identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textrisk.functions.jsontext import sole_object
from textrisk.functions.text import blank_to_null, strip

_UNKNOWN_AUTHOR = "unknown"
_ACCOUNT = "struct<id:string,acct:string,username:string>"


def author_hash(author: Column) -> Column:
    """SHA-256 of the author name, of "unknown" where there is none."""
    return F.sha2(F.coalesce(blank_to_null(author), F.lit(_UNKNOWN_AUTHOR)), 256)


def account_identifier(
    account: Column, flat_id: Column, flat_acct: Column, flat_username: Column
) -> Column:
    """First non-empty of id, acct and username of the account.

    ``account`` is JSON text of the account object; the flat columns are the
    fallback for tables that spread the account over columns.
    """
    inside = sole_object(strip(account), _ACCOUNT)
    return F.coalesce(
        blank_to_null(inside["id"]),
        blank_to_null(inside["acct"]),
        blank_to_null(inside["username"]),
        blank_to_null(flat_id),
        blank_to_null(flat_acct),
        blank_to_null(flat_username),
        F.lit(_UNKNOWN_AUTHOR),
    )


def url_authority(url: Column) -> Column:
    """Authority of a URL with user and port, or null.

    ``parse_url(..., 'HOST')`` would lose user and port.  Brackets are allowed
    only around an IP literal.
    """
    address = F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")
    authority = F.regexp_extract(address, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    well_formed = ~authority.rlike(r"[\[\]]") | authority.rlike(
        r"\A(?:[^\[\]]*@)?\[(?:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*|[vV][0-9A-Fa-f]+\.[^\[\]]+)\](?::[^\[\]]*)?\z"
    )
    return F.when(well_formed, blank_to_null(authority))


def first_authority(*urls: Column) -> Column:
    return F.coalesce(*[url_authority(url) for url in urls])
