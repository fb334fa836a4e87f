"""Framework enrichment: semantic types from paths, names, bases and signatures."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph, reach

_CODE = ("Function", "Method")
_ANY = ()

# Per framework, the modules and the file names that show its use, and rules: labels (any where
# none is named), type given, and the tests one of which has to hold.  Later rules win.
FRAMEWORKS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[tuple[tuple[str, ...], str, tuple[tuple[str, str], ...]], ...]]] = {
    "django": (("django", "django.conf", "django.db", "django.http"), ("manage.py",), (
        (("Function",), "View", (("path", "views.py"),)), (("Class",), "Model", (("base", "Model"),)), (("Function",), "URLPattern", (("path", "urls.py"),)),
        (("Class",), "Serializer", (("path", "serializers.py"),)), (("Function",), "Task", (("path", "tasks.py"), ("decorator", "task"))), (("Class",), "Admin", (("path", "admin.py"),)))),
    "fastapi": (("fastapi",), (), (
        (_ANY, "Route", tuple(("decorator", f".{m}") for m in ("get", "post", "put", "delete", "patch", "head", "options"))), (_CODE, "Route", tuple(("text", f".{m}(") for m in ("get", "post", "put", "delete", "patch", "head", "options"))),
        (_CODE, "Dependency", (("text", "Depends("),)), (_ANY, "Dependency", (("decorator", "Depends"),)), (("Class",), "PydanticModel", (("base is", "BaseModel"), ("docstring", "BaseModel"))),
        (_ANY, "BackgroundTask", (("decorator", "on_event"),)), (_CODE, "BackgroundTask", (("text", "on_event("), ("text", "BackgroundTasks"))))),
    "react": (("react", "react-dom", "next"), ("next.config.js", "next.config.ts", "next.config.mjs"), (
        (_ANY, "ReactComponent", (("path", ".jsx"), ("path", ".tsx"))), (_ANY, "NextPage", (("path", "/pages/"),)), (_ANY, "NextApiRoute", (("path", "/pages/api/"), ("path", "/app/api/"))),
        (_ANY, "ReactHook", (("longer than", "use"),)), (_ANY, "ReactStore", (("name", "createStore"), ("name", "useStore"))))),
    "react_native": (("react-native", "expo"), ("app.json",), (
        (_ANY, "RNComponent", (("path", ".jsx"), ("path", ".tsx"))), (_ANY, "RNScreen", (("path", "/screens/"), ("suffix", "Screen"))), (_ANY, "RNHook", (("longer than", "use"),)),
        (_ANY, "RNNavigation", tuple(("name", n) for n in ("createStackNavigator", "createBottomTabNavigator", "createDrawerNavigator", "createNativeStackNavigator", "NavigationContainer", "useNavigation", "useRoute"))))),
    "express": (("express",), (), (
        (_ANY, "ExpressRoute", tuple(("prefix", f"{o}.{m}") for o in ("app", "router") for m in ("get", "post", "put", "delete", "patch"))), (_ANY, "ExpressMiddleware", (("prefix", "app.use"), ("prefix", "router.use"))),
        (_ANY, "ExpressController", (("path", "/controllers/"),)), (_ANY, "ExpressRouter", (("name is", "Router"), ("name", "Router()"), ("name", "express.Router"))))),
    "rails": (("rails", "active_record", "action_controller"), ("Gemfile",), (
        (_ANY, "RailsController", (("path", "controllers/"),)), (_ANY, "RailsModel", (("path", "models/"),)), (_ANY, "RailsRoute", (("path", "routes.rb"),)), (_ANY, "RailsJob", (("path", "jobs/"),)), (_ANY, "RailsConcern", (("path", "concerns/"),)))),
    "laravel": (("Illuminate",), ("artisan",), (
        (_ANY, "LaravelController", (("path", "Controllers/"),)), (_ANY, "LaravelRoute", (("path", "routes/"),)), (_ANY, "LaravelJob", (("path", "Jobs/"),)), (_ANY, "LaravelPolicy", (("path", "Policies/"),)), (_ANY, "LaravelModel", (("name", "Model"), ("path", "Model"))))),
    "spring": (("org.springframework",), ("application.properties", "application.yml"), tuple(
        (_ANY, given, (("name", mark), ("path", mark))) for mark, given in (("@Controller", "SpringController"), ("@RestController", "SpringRestController"), ("@Service", "SpringService"), ("@Repository", "SpringRepository"), ("@Entity", "SpringEntity")))),
    "terraform": ((), ("main.tf", "variables.tf", "outputs.tf", "providers.tf"), ()),
    "chef": (("chef",), ("metadata.rb", "Berksfile"), ((("File",), "chef_recipe", (("path", "/recipes/"),)), (("File",), "chef_cookbook", (("cookbook", "metadata.rb"),)))),
}


def register(name: str, modules: tuple[str, ...], files: tuple[str, ...], rules: tuple) -> None:
    """Add a framework; see ``FRAMEWORKS`` for what its parts are."""
    FRAMEWORKS[name] = (modules, files, rules)


def detect(g: Graph) -> DataFrame:
    """(framework) one of whose modules is imported, or one of whose files is there, by exact name."""
    imported = g.of("Import").select(F.explode(F.array("name", "path")).alias("n"), F.lit("module").alias("kind"))
    names = imported.unionByName(g.of("File").select(F.col("name").alias("n"), F.lit("file").alias("kind")))
    marks = [(k, kind, n) for k, (modules, files, _) in FRAMEWORKS.items() for kind, all_ in (("module", modules), ("file", files)) for n in all_]
    table = g.spark.createDataFrame(marks, "framework string, kind string, n string")
    return names.join(F.broadcast(table), ["kind", "n"]).select("framework").distinct()


def promote(g: Graph, frameworks: list[str]) -> Graph:
    """The graph with semantic types: one pass of the frameworks' rules over each node that has a file, the
    names of its bases and of its decorators."""
    base = g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("n"))
    bases = g.links("INHERITS").join(base, "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("n").alias("__bases"))
    over = g.of("Decorator").select(F.col("id").alias("src"), F.col("name").alias("n"))
    marks = g.links("DECORATES").join(over, "src").groupBy(F.col("dst").alias("id")).agg(F.collect_set("n").alias("__marks"))
    rows = g.nodes.join(bases, "id", "left").join(marks, "id", "left")
    path, name = F.coalesce("file_path", "path", F.lit("")), F.coalesce("name", F.lit(""))
    doc = F.coalesce("docstring", F.lit(""))
    text = F.concat_ws(" ", F.coalesce("signature", F.lit("")), doc)
    some = lambda column, test: F.coalesce(F.exists(column, test), F.lit(False))
    tests: dict[str, Callable[[str], Column]] = {
        "path": path.contains, "name": name.contains, "name is": lambda x: name == x, "prefix": name.startswith, "longer than": lambda x: name.startswith(x) & (name != x), "suffix": name.endswith,
        "text": text.contains, "docstring": doc.contains, "base": lambda x: some("__bases", lambda b: b.contains(x)), "base is": lambda x: some("__bases", lambda b: b == x),
        "decorator": lambda x: some("__marks", lambda d: d.contains(x)), "cookbook": lambda x: path.contains("/cookbooks/") & (name == x),
    }
    kind = F.col("semantic_type")
    for f in frameworks:
        for labels, given, alternatives in FRAMEWORKS[f][2]:
            holds = F.lit(False)
            for what, part in alternatives:
                holds = holds | tests[what](part)
            of = F.col("label").isin(*labels) if labels else F.lit(True)
            kind = F.when((path != "") & of & holds, F.lit(given)).otherwise(kind)
    return Graph(rows.withColumn("semantic_type", kind).drop("__bases", "__marks"), g.edges)


def _tidy(path: Column) -> Column:
    """A path without '.' and '..' parts; '..' beyond the top stays, so it names nothing."""

    @F.pandas_udf("string")
    def tidy(paths: pd.Series) -> pd.Series:
        return paths.map(posixpath.normpath, na_action="ignore")

    return tidy(path)


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"(?:^|/)[^/]*$", "")


def terraform_edges(g: Graph) -> DataFrame:
    """(src, dst, type) that the meaning of Terraform files adds.

    A module DEPENDS_ON the files of the folder that its source names, relative to its own file, and where that
    holds none, or the source isn't a path, on the files below a folder ``modules/<its name>``.  A resource
    BELONGS_TO the provider that its type begins with, one of its own folder before others.  A variable that
    several files declare REFERENCES the declaration of the first file, by path.
    """
    own = g.nodes.where(F.col("semantic_type").startswith("terraform_")).select("id", "semantic_type", "name", "description", "file_path")
    files = g.of("File").select(F.col("id").alias("dst"), F.col("path"), _folder(F.col("path")).alias("folder"))
    modules = own.where("semantic_type = 'terraform_module'")
    local = modules.where("description LIKE './%' OR description LIKE '../%'")
    named = local.select(F.col("id").alias("src"), _tidy(F.concat_ws("/", F.when(_folder(F.col("file_path")) == "", F.lit(".")).otherwise(_folder(F.col("file_path"))), "description")).alias("folder"))
    by_source = named.join(files, "folder").select("src", "dst")
    # a folder 'modules/<name>' above a file
    below = files.select("dst", F.regexp_extract("path", r"(?:^|/)modules/([^/]+)/", 1).alias("name")).where("name <> ''")
    by_name = modules.select(F.col("id").alias("src"), "name").join(by_source.select("src").distinct(), "src", "left_anti").join(below, "name").select("src", "dst")
    depends = by_source.unionByName(by_name).distinct().withColumn("type", F.lit("DEPENDS_ON"))
    providers = own.where("semantic_type = 'terraform_provider'").select(F.col("id").alias("dst"), F.col("name").alias("provider"), _folder(F.col("file_path")).alias("there"))
    resources = own.where("semantic_type IN ('terraform_resource', 'terraform_data')").select(F.col("id").alias("src"), F.element_at(F.split(F.regexp_replace("name", r"^data\.", ""), "_"), 1).alias("provider"), _folder(F.col("file_path")).alias("here"))
    first = F.min_by("dst", F.struct((F.col("here") != F.col("there")).alias("far"), "there", "dst"))
    belongs = resources.join(providers, "provider").groupBy("src").agg(first.alias("dst")).withColumn("type", F.lit("BELONGS_TO"))
    variables = own.where("semantic_type = 'terraform_variable'").select("id", "name", "file_path")
    home = variables.groupBy("name").agg(F.min_by("id", F.struct("file_path", "id")).alias("dst"), F.count("*").alias("n")).where("n > 1")
    same = variables.join(home, "name").where("id <> dst").select(F.col("id").alias("src"), "dst", F.lit("REFERENCES").alias("type"))
    return depends.unionByName(belongs.select("src", "dst", "type")).unionByName(same)


def chef_edges(g: Graph) -> DataFrame:
    """(src, dst, type): a file that includes a recipe DEPENDS_ON the recipe's file.

    'book::name' is the file recipes/name.rb of a cookbook's folder, 'book' its default recipe, and '::name'
    one of the includer's own cookbook; ``included`` follows such edges to their end.
    """
    path = F.coalesce("path", F.lit(""))
    files = g.of("File").select("id", F.regexp_extract(path, r"(?:^|/)([^/]+)/recipes/[^/]+\.rb$", 1).alias("book"), F.regexp_extract(path, r"/recipes/([^/]+)\.rb$", 1).alias("recipe"), path.alias("path"))
    own_book = F.regexp_extract("file_path", r"(?:^|/)([^/]+)/(?:recipes|libraries|resources|attributes|providers)/", 1)
    calls = g.of("Import").where(F.col("signature").startswith("include_recipe")).select("name", "file_path", own_book.alias("mine"))
    said = F.split("name", "::")
    book = F.when(F.element_at(said, 1) == "", F.col("mine")).otherwise(F.element_at(said, 1))
    wanted = calls.select("file_path", book.alias("book"), F.when(F.size(said) > 1, F.element_at(said, 2)).otherwise("default").alias("recipe"))
    hit = wanted.join(files.where("recipe <> ''").select("book", "recipe", F.col("id").alias("dst")), ["book", "recipe"])
    from_ = files.select(F.col("path").alias("file_path"), F.col("id").alias("src"))
    return hit.join(from_, "file_path").where("src <> dst").select("src", "dst", F.lit("DEPENDS_ON").alias("type")).distinct()


def with_edges(g: Graph, *edges: DataFrame) -> Graph:
    """The graph with further edges."""
    all_ = g.edges.select("src", "dst", "type")
    for e in edges:
        all_ = all_.unionByName(e.select("src", "dst", "type"))
    return Graph(g.nodes, all_.distinct())


def included(g: Graph, roots: DataFrame) -> DataFrame:
    """(id, level) of all that roots depend on, however far: rounds that end when one finds nothing new."""
    return reach(g, roots, ["DEPENDS_ON"], None)


def terraform_links(variables: DataFrame, uses: DataFrame) -> DataFrame:
    """References of one file to variables that another declares: (file_path, name, declared_in)."""
    v = variables.select("name", F.col("file_path").alias("declared_in"))
    return uses.select("file_path", "name").join(v, "name").where("file_path <> declared_in").distinct()


def provider_groups(resources: DataFrame) -> DataFrame:
    """(provider, n): resources by the part of their type before the first underscore."""
    return resources.groupBy(F.element_at(F.split("name", "_"), 1).alias("provider")).agg(F.count("*").alias("n"))
