"""Shared session and helpers."""

from __future__ import annotations

import pytest

from webloom.session import build_session, remove_scratch


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "webloom-tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_scratch(session)
    session.stop()
