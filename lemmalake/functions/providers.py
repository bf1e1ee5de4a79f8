"""Models and verifiers as table functions. What really generates or verifies is plugged in; rows keep their keys, so order doesn't matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A provider turns the values of one batch's input column into rows of its schema, one for each value.
Provider = tuple[Callable[[pd.Series], pd.DataFrame], str]


def echo(prompts: pd.Series) -> pd.DataFrame:
    """A stand-in model: the output is the prompt's last line in a fence."""
    last = prompts.fillna("").str.rstrip().str.rsplit("\n", n=1).str[-1]
    return pd.DataFrame({"response": "```lean4\n" + last + "\n```", "input_chars": prompts.str.len().fillna(0).astype("int64"), "is_error": prompts.isna()})


def closes(code: pd.Series) -> pd.DataFrame:
    """A stand-in verifier: code passes if it ends with a tactic that closes goals and has no hole."""
    s = code.fillna("").str.strip()
    passed = s.str.endswith(("omega", "norm_num", "decide")) & ~s.str.contains("sorry", regex=False)
    return pd.DataFrame({"verdict": passed, "system_error": code.isna()})


REGISTRY: dict[str, Provider] = {
    "echo": (echo, "response string, input_chars bigint, is_error boolean"),
    "closes": (closes, "verdict boolean, system_error boolean"),
}


def call(df: DataFrame, provider: str, key: str, column: str) -> DataFrame:
    """(key, columns of the provider) for every row; an unknown name is refused. Null input is the provider's to judge; no rows give none."""
    if provider not in REGISTRY:
        raise ValueError(f"no provider {provider}: {', '.join(REGISTRY)}")
    function, schema = REGISTRY[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = function(b[column])
            out.insert(0, key, b[key].to_numpy())
            yield out

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInPandas(run, f"{key} {kind}, {schema}")
