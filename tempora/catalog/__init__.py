"""Every registered query and its comparison SQL."""

from __future__ import annotations

import importlib

KNOWN: dict = {}
SECTIONS = ("inputs", "pit", "quality", "dates", "returns", "portfolio", "curves", "validation")


def views_of(spark, sf_dir: str):
    """The views of a folder, whose shared tables are written once a session."""
    from tempora.catalog.views import Views
    from tempora.session import exists

    mine = spark.sparkContext.applicationId
    for key in [k for k in KNOWN if k[0] != mine]:
        del KNOWN[key]
    known = KNOWN.get((mine, sf_dir))
    if known is None or not all(exists(spark, f) for f in known.folders):
        known = KNOWN[mine, sf_dir] = Views(spark, sf_dir)
    return known


def forget(spark) -> None:
    """Drops the views and deletes what they wrote."""
    from tempora.session import discard

    KNOWN.clear()
    discard(spark)


def load(sections=SECTIONS):
    from tempora.catalog.present import present

    queries, oracle = {}, {}
    for section in sections:
        module = importlib.import_module(f"tempora.catalog.{section}")
        for name, fn in module.QUERIES.items():
            queries[name] = (lambda f: lambda spark, sf_dir: present(f(views_of(spark, sf_dir)), getattr(f, "digits", 6)))(fn)
        oracle.update(module.ORACLE)
    return queries, oracle
