"""Registered queries and the SQL they are compared with."""


def registries() -> list:
    """The registries of the core, imported when asked for."""
    from wordloom.plans import delivery, documents, events, pages, roundtrips, sessions

    return [m.registry for m in (documents, pages, sessions, events, delivery, roundtrips)]
