"""Identifier expressions in long lines and before other words."""

from __future__ import annotations

import time

import pytest

from millrace.llm.licences import longest_expression, scan_licences, tokens_at


def labels(spark, text):
    return scan_licences(spark.createDataFrame([(text,)], "text string")).first()


@pytest.mark.parametrize(("line", "found", "permitted"), [
    ("SPDX-License-Identifier: MIT See LICENSE for more", "mit", True),
    ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause, and so on", "bsd-3-clause,gpl-2,mit", True),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */ code", "gpl-2", False),
    ("<!-- SPDX-License-Identifier: Apache-2.0--> MIT", "apache-2", True),
    ("SPDX-License-Identifier: MIT OR", "", None),
    ("SPDX-License-Identifier: MIT (see the file)", "mit", True),
    ("SPDX-License-Identifier: (MIT", "", None),
    ("SPDX-License-Identifier: MIT.\nGPL-3.0", "mit", True),
    ("SPDX-License-Identifier:\nMIT", "", None),
    ("SPDX-License-Identifier: " + "MIT OR " * 700 + "GPL-2.0-only", "gpl-2,mit", True),
])
def test_expression_behind_a_tag(spark, line, found, permitted):
    row = labels(spark, line)
    assert (row.labels, row.permitted) == (found, permitted)


def test_expression_of_any_length_in_time():
    body = b"(" + b" OR ".join([b"MIT"] * 200_000) + b") AND ISC rest of the line"
    start = time.perf_counter()
    polish, used = longest_expression(tokens_at(body, 0, len(body)))
    assert used == 400_003 and len(polish) == 400_001 and polish[-2:] == ["ISC", "and"]
    assert time.perf_counter() - start < 5
