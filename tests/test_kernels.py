import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lattix.functions import globs, kernels
from lattix.sources import recipes, skills
from lattix.sources.modules import package_of, section_types, tool_from_path
from lattix.sources.pipelines import includes, module_paths

EDGES = st.lists(st.tuples(st.integers(0, 5), st.sampled_from("abcdef"), st.sampled_from("abcdef")), max_size=20)


@given(EDGES)
@settings(max_examples=200, deadline=None)
def test_no_cycle_stays_and_order_is_least(edges):
    kept = kernels.break_cycles(edges)
    order = kernels.smallest_order(kept)
    assert set(order) == {x for e in kept for x in e} and all(order.index(a) < order.index(b) for a, b in kept)
    if len(order) <= 6:
        every = (p for p in itertools.permutations(sorted(order)) if all(p.index(a) < p.index(b) for a, b in kept))
        assert order == list(next(every, ()))
    assert kernels.break_cycles(random.Random(0).sample(edges, len(edges))) == kept


@given(st.lists(st.sampled_from("abcd"), max_size=6, unique=True), st.lists(st.sampled_from("abcd"), max_size=6, unique=True), st.sets(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcd")), max_size=5))
@settings(max_examples=150, deadline=None)
def test_matching_is_largest(gold, pred, same):
    got = kernels.match_steps(gold, pred, same)
    fits = lambda g, p: g == p or (g, p) in same or (p, g) in same
    assert len(set(got.values())) == len(got) and all(fits(gold[i], pred[j]) for i, j in got.items())

    def most(i, free):
        return 0 if i == len(gold) else max([most(i + 1, free), *(1 + most(i + 1, free - {j}) for j in free if fits(gold[i], pred[j]))])

    assert len(got) == most(0, frozenset(range(len(pred))))


def test_flow_chart():
    text = "flowchart TB\nv1([A:FASTQC])\nv2[reads]\nv3([ALIGN])\nv4([MULTIQC])\nv5([B:COUNT])\nv1 --> v2\nv2 --> v3\nv3 --> v4\nv4 --> v5\nv3 -->|x| v5\nv5 --> v5\n"
    assert kernels.process_edges(text) == [(1, "FASTQC", "ALIGN"), (3, "ALIGN", "COUNT"), (3, "ALIGN", "MULTIQC"), (4, "MULTIQC", "COUNT")]


def test_answers():
    p = kernels.parse_answer
    assert p('take ["a", " b ", 3] then ["c"]') == ["a", "b"] and p("[]") == [] and p("[1] and [\"x]\"]") == ["x]"] and p('see [1, 2] or ["y"]') == ["y"]
    assert p(None) is None and p("a, b, c") is None and p('["open"') is None and p('[["in"], "out"]') == ["out"]


def test_globs():
    one = {
        "*.bam": "fmt:format_2572", "*.vcf.gz": "fmt:format_3016", "*.fastq.gz": "fmt:format_1930", "*.BAM": "fmt:format_2572", "sample_*.bam": "fmt:format_2572", "*.sf": "fmt:pat:.sf", "*.xyz": "fmt:pat:.xyz",
        "*.{bam}": "fmt:format_2572", "*.{fastq,fq}.gz": "fmt:format_1930", "*_fastqc.html": "fmt:format_2331", "*.${prefix}.{gtf}": "fmt:format_2306", "*.gff3": "fmt:format_1975", "*.fasta[.gz]": "fmt:format_1929",
        "*_[12].vcf.gz": "fmt:format_3016", "*": "fmt:pat:.", "x*..own": "fmt:pat:.own",
    }
    for pattern, want in one.items():
        assert globs.format_ids(pattern) == [want], pattern
    assert globs.format_ids("*.{bam,cram,sam}") == ["fmt:format_2572", "fmt:format_3462", "fmt:format_2573"] and globs.format_ids("*.bam|*.SAM") == ["fmt:format_2573"]
    assert globs.format_ids("*.bai|csi|crai") == ["fmt:format_3327", "fmt:pat:.csi", "fmt:pat:.crai"]
    assert set(globs.choices("a{b,{c,d}}{e|f}")) == {"abe", "abf", "ace", "acf", "ade", "adf"}


def test_manifest_helpers():
    assert section_types([[{"x": {"pattern": "*.bam", "ontologies": [{"edam": "http://edam/format_1", "other": "http://o/x", "deep": {"pattern": "*.no"}}]}}]]) == ["http://edam/format_1", "fmt:format_2572"]
    assert package_of(["bioconda::samtools=1.2", "conda-forge::r=4"], "Samtools", False) == ("samtools", "1.2") and package_of(["bioconda::x=1"], "y", False) is None and package_of(["bioconda::x=1"], "y", True) == ("x", "1")
    assert tool_from_path("/a/nf-core/bcftools/sort/meta.yml") == "bcftools" and tool_from_path("/a/nf-core/fastqc/meta.yml") == "" and tool_from_path("/a/b/meta.yml") == ""
    assert module_paths('{"repos": {"u": {"modules": {"o": {"b": {}, "a": {}}}}}}') == ["a", "b"]
    assert includes("include { A ; B as C } from '../m/x'") == {"A": "../m/x", "C": "../m/x"}


def test_recipes_and_skills():
    text = 'process A {\n  container "${ workflow.engine == \'s\' ? \'https://h/img\' : \'quay.io/x:1\' }"\n  input:\n  tuple val(meta), path(reads)\n  output:\n  path "*.bam", emit: bam\n  script:\n  """\n  run me\n  """\n}\n'
    assert recipes.containers(text) == ("quay.io/x:1", "https://h/img") and recipes.command(text) == {"kind": "heredoc", "ref": "run me"}
    assert recipes.channels(text, "input") == ["meta", "reads"] and "bam" in recipes.channels(text, "output")
    s = skills.parse_skill("---\nname: s\nprimary_tool: STAR\n---\nUse star and salmon.", {"salmon", "star"})
    assert s["tools"] == ["STAR"] and s["context_tools"] == ["salmon"] and skills.parse_skill("no head", set()) is None
