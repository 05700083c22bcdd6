"""Formats that a whole file has to be read for: parsers, and their use on executors, a file a task."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _parsed(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(parse(bytes(content)), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def wrapped_fastq(data: bytes) -> list[tuple]:
    """(ord, id, header, seq, qual); sequences and qualities may go over lines."""
    lines, at, out = data.decode("utf-8").splitlines(), 0, []
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        if not lines[at].startswith("@"):
            raise ValueError(f"line {at + 1}: no read header")
        header, seq, qual = lines[at][1:], "", ""
        at += 1
        while at < len(lines) and not lines[at].startswith("+"):
            seq += lines[at].strip()
            at += 1
        if at == len(lines):
            raise ValueError("truncated read")
        if lines[at][1:] not in ("", header):
            raise ValueError(f"line {at + 1}: the headers differ")
        at += 1
        while at < len(lines) and len(qual) < len(seq):
            qual += lines[at].strip()
            at += 1
        if len(qual) != len(seq):
            raise ValueError(f"read {header}: sequence and quality differ in length")
        out.append((len(out), header.split()[0] if header.split() else "", header, seq, qual))
    return out


def fastq_wrapped(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, wrapped_fastq, "ord long, id string, header string, seq string, qual string")


def mmcif_atoms(data: bytes) -> list[tuple]:
    """(model, chain, resseq, resname, name, element, x, y, z, b) of the first _atom_site loop; author fields come first."""
    tokens = re.findall(r"""'(?:[^'\n]|'(?=\S))*'|"(?:[^"\n]|"(?=\S))*"|^;[\s\S]*?^;|#[^\n]*|\S+""", data.decode("utf-8"), re.M)
    tokens = [t for t in tokens if not t.startswith("#")]
    for i, t in enumerate(tokens):
        if t == "loop_" and i + 1 < len(tokens) and tokens[i + 1].startswith("_atom_site."):
            j = i + 1
            while tokens[j].startswith("_"):
                j += 1
            names = [n[11:] for n in tokens[i + 1 : j]]
            break
    else:
        return []
    out = []
    while j + len(names) <= len(tokens) and tokens[j] != "loop_" and not tokens[j].startswith(("_", "data_")):
        row = dict(zip(names, (t.strip("'\"") for t in tokens[j : j + len(names)])))
        j += len(names)
        pick = lambda *keys, default="": next((row[k] for k in keys if row.get(k, "?") not in ("?", ".")), default)
        if row.get("label_alt_id", ".") in (".", "?", "A", "1"):
            out.append((pick("pdbx_PDB_model_num", default="1"), pick("auth_asym_id", "label_asym_id"), pick("auth_seq_id", "label_seq_id", default=f"atom-{row.get('id', len(out))}"), pick("auth_comp_id", "label_comp_id", default="UNK"),
                        pick("auth_atom_id", "label_atom_id", default="?"), pick("type_symbol"), float(row["Cartn_x"]), float(row["Cartn_y"]), float(row["Cartn_z"]), float(pick("B_iso_or_equiv", default="nan"))))
    return out


def mmcif(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, mmcif_atoms, "model string, chain string, resseq string, resname string, name string, element string, x double, y double, z double, b double")


def mzml_peaks(data: bytes) -> list[tuple]:
    """(index, ms_level, i, mz, intensity): the arrays of each spectrum, 32 or 64 bits, packed or not."""
    out = []
    for _, e in ElementTree.iterparse(__import__("io").BytesIO(data)):
        if e.tag.rpartition("}")[2] != "spectrum":
            continue
        level, arrays = 1, {}
        for child in e.iter():
            tag = child.tag.rpartition("}")[2]
            if tag == "cvParam" and child.get("accession") == "MS:1000511":
                level = int(child.get("value"))
            if tag == "binaryDataArray":
                marks = {c.get("accession") for c in child.iter() if c.tag.rpartition("}")[2] == "cvParam"}
                text = next((c.text for c in child.iter() if c.tag.rpartition("}")[2] == "binary"), "") or ""
                raw = base64.b64decode(text)
                raw = zlib.decompress(raw) if "MS:1000574" in marks and raw else raw
                wide = "MS:1000523" in marks
                arrays["mz" if "MS:1000514" in marks else "intensity"] = struct.unpack(f"<{len(raw) // (8 if wide else 4)}{'d' if wide else 'f'}", raw)
        out += [(int(e.get("index", len(out))), level, i, float(m), float(v)) for i, (m, v) in enumerate(zip(arrays.get("mz", ()), arrays.get("intensity", ())))]
        e.clear()
    return out


def mzml(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, mzml_peaks, "index long, ms_level int, i long, mz double, intensity double")


def newick_edges(text: str) -> list[tuple]:
    """(node, parent, label, length) of a Newick tree; the root's parent is None.

    Inner nodes need two children, leaves a label, and nothing may follow ';'.
    """
    tokens = re.findall(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]']+", text)
    tokens = [t for t in tokens if not t.startswith("[")]
    out, at = [], 0

    def node(parent):
        nonlocal at
        own = len(out)
        out.append(None)
        children = 0
        if at < len(tokens) and tokens[at] == "(":
            while True:
                at += 1
                node(own)
                children += 1
                if at >= len(tokens) or tokens[at] not in ",)":
                    raise ValueError("unclosed tree")
                if tokens[at] == ")":
                    at += 1
                    break
            if children < 2:
                raise ValueError("an inner node needs two children")
        label, length = "", None
        if at < len(tokens) and tokens[at] not in "(),:;":
            label = tokens[at][1:-1].replace("''", "'") if tokens[at].startswith("'") else tokens[at]
            at += 1
        if at < len(tokens) and tokens[at] == ":":
            length = float(tokens[at + 1])
            if not 0 <= length < float("inf"):
                raise ValueError("bad branch length")
            at += 2
        if not children and not label:
            raise ValueError("a leaf needs a label")
        out[own] = (own, parent, label, length)

    node(None)
    if at >= len(tokens) or tokens[at] != ";" or at + 1 != len(tokens):
        raise ValueError("a tree ends with ';'")
    return out


def newick(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(newick_edges(text), "node long, parent long, label string, length double")


def rerooted(edges: list[tuple], leaf: str) -> list[tuple]:
    """The tree with its root in the middle of a leaf's edge; the other edges are turned around.

    An old root that is left with one child goes, and its two edges become one.
    """
    found = [e for e in edges if e[2] == leaf and not any(c[1] == e[0] for c in edges)]
    if len(found) != 1 or found[0][1] is None:
        raise ValueError("the label must be that of one leaf")
    by = {e[0]: e for e in edges}
    at, new, half = found[0], max(by) + 1, (found[0][3] or 0.0) / 2
    out = {new: (new, None, "", None), at[0]: (at[0], new, at[2], half)}
    below, length = new, half
    node = by[at[1]]
    while True:
        out[node[0]] = (node[0], below, node[2], length)
        if node[1] is None:
            break
        below, length, node = node[0], node[3], by[node[1]]
    rows = [out.get(e[0], e) for e in [*edges, out[new]]]
    children = [e for e in rows if e[1] == node[0]]
    if len(children) == 1:
        old, child = out[node[0]], children[0]
        joined = None if old[3] is None and child[3] is None else (old[3] or 0.0) + (child[3] or 0.0)
        rows = [(e[0], old[1], e[2], joined) if e[0] == child[0] else e for e in rows if e[0] != node[0]]
    return sorted(rows, key=lambda e: e[0])


def newick_text(edges: list[tuple]) -> str:
    children: dict = {}
    for e in edges:
        children.setdefault(e[1], []).append(e)

    def one(e) -> str:
        inner = ",".join(map(one, children.get(e[0], [])))
        label = "'" + e[2].replace("'", "''") + "'" if re.search(r"[\s(),:;\[\]']", e[2]) else e[2]
        length = "" if e[3] is None else ":" + (f"{e[3]:.12f}".rstrip("0").rstrip(".") or "0")
        return (f"({inner})" if inner else "") + label + length

    return one(children[None][0]) + ";"


def meme_matrix(text: str) -> tuple[str, list[list[float]]]:
    """(alphabet, rows) of the first probability matrix."""
    alphabet = re.search(r"ALPHABET=\s*(\S+)", text)
    body = re.split(r"letter-probability matrix:[^\n]*\n", text, maxsplit=1)
    if not alphabet or len(body) < 2:
        raise ValueError("no motif")
    rows = []
    for line in body[1].splitlines():
        try:
            rows.append([float(x) for x in line.split()])
        except ValueError:
            break
        if not rows[-1]:
            rows.pop()
            break
    return alphabet[1], rows


def sniffed(head: bytes, name: str = "") -> str:
    """The format of a file by its first bytes, else by its name, else 'unknown'."""
    if head[:2] == b"\x1f\x8b":
        try:
            head = zlib.decompressobj(31).decompress(head)
        except zlib.error:
            return "unknown"
    for magic, kind in ((b"BAM\1", "bam"), (b"BCF\2", "bcf"), (b"CRAM", "cram"), (b"\x89HDF\r\n", "hdf5")):
        if head.startswith(magic):
            return kind
    text = head.decode("utf-8", "replace")
    lines = [x for x in text.splitlines() if x.strip()]
    first = lines[0] if lines else ""
    data = [x.split("\t") for x in lines if not x.startswith(("#", "track ", "browser "))][:4]
    whole = lambda x: x.isdigit()
    if "<BlastOutput" in text:
        return "blast-xml"
    if first.startswith("##fileformat=VCF"):
        return "vcf"
    if first.startswith("##gff-version 3"):
        return "gff3"
    if first.startswith("@") and any(x.startswith("+") for x in lines[1:]) and not re.match(r"@(HD|SQ|RG|PG|CO)\t", first):
        return "fastq"
    if first.startswith(">"):
        return "fasta"
    if "_atom_site." in text:
        return "mmcif"
    if re.search(r"^(ATOM  |HETATM)", text, re.M):
        return "pdb"
    if re.match(r"@(HD|SQ|RG|PG|CO)\t", first):
        return "sam"
    if first.startswith("HMMER3"):
        return "hmmer3"
    if first.startswith("MEME version"):
        return "meme"
    if first.startswith("%%MatrixMarket"):
        return "matrix-market"
    if data and all(len(x) == 12 and re.fullmatch(r"[\d.]+", x[2]) for x in data):
        return "blast-tabular"
    if first.startswith("(") and text.rstrip().endswith(";"):
        return "newick"
    if data and all(len(x) == 9 and whole(x[3]) and whole(x[4]) for x in data):
        return "gtf" if re.search(r'\w+ "', data[0][8]) else "gff3"
    if data and all(3 <= len(x) <= 12 and whole(x[1]) and whole(x[2]) for x in data):
        return "bed"
    for sep, kind in (("\t", "tsv"), (",", "csv")):
        if len(lines) > 1 and lines[0].count(sep) and lines[0].count(sep) == lines[1].count(sep):
            return kind
    return next((k for e, k in ((".csv", "csv"), (".tsv", "tsv"), (".bed", "bed"), (".nwk", "newick")) if name.lower().endswith(e)), "unknown")
