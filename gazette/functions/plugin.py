"""Plug-in annotator: run a caller's NLP model over a text column.

The rule operators only depend on the sentence/token schema, so any model
can replace the native annotator: ``annotate_with`` calls ``model(text)`` on
Arrow batches inside ``mapInPandas`` and expects, per text, a list of
sentences ``{"text": str, "tokens": [{"text", "ws", "lemma", "pos", "dep",
"head", "is_stop", "is_quote"}, ...]}`` (``head`` = index in the sentence).
The model is built once per Python worker (``factory``), not per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

TOKEN_TYPE = ("struct<i:int,text:string,ws:string,lemma:string,pos:string,dep:string,"
              "head:int,is_stop:boolean,is_quote:boolean>")
SENTENCES_TYPE = f"array<struct<sent:int,text:string,tokens:array<{TOKEN_TYPE}>>>"

_MODELS: dict = {}


def annotate_with(df: DataFrame, factory, text_col: str = "text", id_col: str = "id",
                  out_col: str = "sentences", model_name: str | None = None) -> DataFrame:
    """(id, sentences) with ``sentences`` produced by ``factory()(text)``.

    A worker keeps a model only under a ``model_name``; without one it is built
    per task, since a worker cannot tell two factories apart."""
    from ..operators.common import spread
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        model = _MODELS.get(model_name) or factory()
        if model_name is not None:
            _MODELS[model_name] = model
        for pdf in batches:
            out = []
            for text in pdf[text_col]:
                if text is None:
                    out.append(None)
                    continue
                sents = []
                for k, s in enumerate(model(text)):
                    toks = [dict(t, i=i) for i, t in enumerate(s["tokens"])]
                    sents.append({"sent": k, "text": s["text"], "tokens": toks})
                out.append(sents)
            pdf[out_col] = out
            yield pdf[[id_col, out_col]]

    return spread(df.select(id_col, text_col)).mapInPandas(
        run, f"{id_col} {id_type}, {out_col} {SENTENCES_TYPE}")
