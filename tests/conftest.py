import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gazette.session import get_session
    s = get_session("local[4]", app="gazette-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TOKEN_SCHEMA = ("array<struct<i:int,text:string,ws:string,lemma:string,pos:string,dep:string,"
                "head:int,is_stop:boolean,is_quote:boolean>>")


def toks(spec: str):
    """'How/how/ADV to/to/PART' -> token dicts; lemma defaults to lower text,
    POS to PUNCT for non-word text else NOUN; 'x/l/P/dep>h' sets dep/head."""
    out = []
    for i, item in enumerate(spec.split()):
        parts = item.split("/")
        text = parts[0]
        lemma = parts[1] if len(parts) > 1 and parts[1] else text.lower()
        pos = parts[2] if len(parts) > 2 and parts[2] else ("NOUN" if text[0].isalnum() else "PUNCT")
        dep, head = "dep", i
        if len(parts) > 3:
            dep, _, h = parts[3].partition(">")
            head = int(h) if h else i
        out.append(dict(i=i, text=text, ws=" ", lemma=lemma, pos=pos, dep=dep, head=head,
                        is_stop=False, is_quote=text in ('"', "'")))
    return out
