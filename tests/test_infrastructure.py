from lodestone.operators import enrichment
from lodestone.sources import code


def tree(root, **files):
    for path, text in files.items():
        p = root / path.replace("__", "/")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def named(g, edges):
    n = {r.id: (r["name"], r.path or r.file_path) for r in g.nodes.collect()}
    return {(n[r.src][0], r.type, n[r.dst][1] if r.type == "DEPENDS_ON" else n[r.dst][0]) for r in edges.collect()}


def test_terraform(spark, tmp_path):
    tree(tmp_path, **{
        "env__prod__main.tf": 'module "net" {\n  source = "../../modules/net"\n}\nmodule "dns" {\n  source = "registry/dns"\n}\nresource "aws_vpc" "v" {\n  cidr = var.cidr\n}\ndata "google_zone" "z" {\n}\nvariable "cidr" {\n}\nprovider "aws" {\n}\n',
        "modules__net__main.tf": 'module "sub" {\n  source = "./sub"\n}\nvariable "cidr" {\n}\n', "modules__net__out.tf": 'output "x" {\n  value = var.cidr\n}\n',
        "modules__net__sub__s.tf": 'variable "deep" {\n}\n', "modules__dns__d.tf": 'provider "google" {\n}\n',
    })
    g, _ = code.ingest(spark, str(tmp_path))
    edges = enrichment.terraform_edges(g)
    assert named(g, edges) == {
        ("net", "DEPENDS_ON", "modules/net/main.tf"), ("net", "DEPENDS_ON", "modules/net/out.tf"), ("sub", "DEPENDS_ON", "modules/net/sub/s.tf"), ("dns", "DEPENDS_ON", "modules/dns/d.tf"),
        ("aws_vpc.v", "BELONGS_TO", "aws"), ("data.google_zone.z", "BELONGS_TO", "google"), ("cidr", "REFERENCES", "cidr"),
    }
    assert enrichment.with_edges(g, edges).edges.count() == g.edges.count() + edges.count()


def test_chef(spark, tmp_path):
    tree(tmp_path, **{
        "cookbooks__web__recipes__default.rb": "include_recipe 'base::users'\ninclude_recipe '::tls'\npackage 'nginx'\n", "cookbooks__web__recipes__tls.rb": "include_recipe \"certs\"\n",
        "cookbooks__base__recipes__users.rb": "user 'web'\n", "cookbooks__certs__recipes__default.rb": "include_recipe 'base::users'\ninclude_recipe 'nowhere::x'\n", "cookbooks__web__metadata.rb": "name 'web'\n",
    })
    g, _ = code.ingest(spark, str(tmp_path))
    edges = enrichment.chef_edges(g)
    c = "cookbooks"
    assert {(a, b) for a, _, b in named(g, edges)} == {("default.rb", f"{c}/base/recipes/users.rb"), ("default.rb", f"{c}/web/recipes/tls.rb"), ("tls.rb", f"{c}/certs/recipes/default.rb")}
    assert edges.count() == 4
    whole = enrichment.with_edges(g, edges)
    start = g.of("File").where(f"path = '{c}/web/recipes/default.rb'").select("id")
    found = whole.attach(enrichment.included(whole, start), "path")
    assert {(r.path, r.level) for r in found.collect()} == {(f"{c}/base/recipes/users.rb", 1), (f"{c}/web/recipes/tls.rb", 1), (f"{c}/certs/recipes/default.rb", 2)}
