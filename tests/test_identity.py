"""Declared identities and the tiers by which authors are resolved."""

import pytest

from lodestrata.operators import identity
from lodestrata.sources import declarations

V2 = """
schema_version = "identity-v2"
[tenant]
email_patterns = ["@home\\\\.test$"]
[[actors]]
canonical_id = "alice"
email_sha256 = ["{alice}"]
attribution_state = "verified"
github_login = "alice-gh"
consent = "recorded-explicit-consent"
authority = "subject-authorization"
[[actors]]
canonical_id = "carol"
emails = ["Carol@Work.test"]
attribution_state = "external"
[[actors]]
canonical_id = "dora"
"""
MAIL = "line int, canonical_name string, canonical_email string, alias_name string, alias_email string"


def resolved(spark, authors, declared=None, mailmap=(), patterns=()):
    people = spark.createDataFrame(authors, "author_name string, author_email string")
    declared = declared if declared is not None else spark.createDataFrame([], declarations.DECLARED)
    rows = identity.resolve(people, declared, spark.createDataFrame(list(mailmap), MAIL), tuple(patterns)).collect()
    return {(r.author_name, r.author_email): r for r in rows}


def test_tiers(spark):
    declared, patterns = declarations.declared_identities(spark, V2.replace("{alice}", declarations.email_digest("alice@old.test")))
    assert patterns == [r"@home\.test$"] and "emails" not in declared.columns
    mailmap = [(1, "Alice", "alice@old.test", None, "al@laptop.test"), (2, "Bob", "bob@x.test", None, "bob@y.test")]
    authors = [("Alice", " Alice@OLD.test "), ("Al", "al@laptop.test"), ("Carol", "carol@work.test"), ("Bob", "bob@y.test"), ("Bob", "bob@x.test"), ("Eve", "eve@home.test"), ("No  Mail", " "), ("no mail", None), (" ", "")]
    got = resolved(spark, authors, declared, mailmap, patterns)
    assert {k: (r.basis, r.partition_key, r.state) for k, r in got.items()} == {
        authors[0]: ("explicit_identity", "identity:alice", "verified"),
        authors[1]: ("explicit_identity", "identity:alice", "verified"),
        authors[2]: ("explicit_identity", "identity:carol", "external"),
        authors[3]: ("mailmap", "email:bob@x.test", "unresolved"),
        authors[4]: ("email", "email:bob@x.test", "unresolved"),
        authors[5]: ("email", "email:eve@home.test", "inferred"),
        authors[6]: ("missing_email_name", "name:no mail", "unresolved"),
        authors[7]: ("missing_email_name", "name:no mail", "unresolved"),
        authors[8]: ("unresolved", None, "unresolved"),
    }
    assert got[authors[1]].login == "alice-gh" and got[authors[2]].login is None


def test_same_address_merges_and_same_name_splits(spark):
    got = resolved(spark, [("Alice Old", " Alice@Example.test"), ("Alice New", "alice@example.test"), ("Alice New", "other@example.test")])
    keys = {k: r.partition_key for k, r in got.items()}
    assert len(keys) == 3 and len(set(keys.values())) == 2 and keys["Alice Old", " Alice@Example.test"] == keys["Alice New", "alice@example.test"]


def test_conflicts_are_kept(spark):
    own = declarations.email_digest("x@x.test")
    rows = [("b", own, "verified", "b-gh", None, None), ("a", own, "claimed", None, None, None), ("a", own, "claimed", None, None, None)]
    r = resolved(spark, [("X", "x@x.test")], spark.createDataFrame(rows, declarations.DECLARED))["X", "x@x.test"]
    assert (r.basis, r.partition_key, r.candidates, r.state, r.login) == ("conflicting_identity", None, ["a", "b"], "unresolved", None)


@pytest.mark.parametrize(
    "text",
    [
        'schema_version = "identity-v3"',
        'schema_version = "identity-v2"\nextra = 1',
        'schema_version = "identity-v2"\n[[actors]]\ncanonical_id = "a"\nnickname = "b"',
        '[[actors]]\ncanonical_id = "A@x"',
        '[[actors]]\ncanonical_id = "actor_0123456789ab"',
        '[[actors]]\ncanonical_id = "a"\n[[actors]]\ncanonical_id = "a"',
        '[[actors]]\ncanonical_id = "a"\nattribution_state = "guessed"',
        '[[actors]]\ncanonical_id = "a"\nconsent = "recorded-explicit-consent"',
        'schema_version = "identity-v2"\n[[actors]]\ncanonical_id = "a"\nattribution_state = "claimed"\nconsent = "recorded-explicit-consent"',
        'schema_version = "identity-v2"\n[[actors]]\ncanonical_id = "a"\nemail_sha256 = ["XY"]',
        f'schema_version = "identity-v2"\n[[actors]]\ncanonical_id = "a"\nemails = ["x@x.test"]\n[[actors]]\ncanonical_id = "b"\nemail_sha256 = ["{declarations.email_digest("X@x.test ")}"]',
        '[[actors]]\ncanonical_id = "a"\nemails = ["x@x.test", " X@x.test"]',
        '[[actors]]\ncanonical_id = "a"\nemails = [""]',
    ],
)
def test_invalid_declarations(spark, text):
    with pytest.raises(declarations.DeclarationError):
        declarations.declared_identities(spark, text)
