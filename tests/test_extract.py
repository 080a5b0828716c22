"""Framework and language readers, look-alikes in comments and strings included."""

import pytest

from lattica.extract import api_calls, frameworks, syntax


def routes(name, path, source):
    return {(r[1], r[2]) for r in frameworks.REGISTRY[name][1](path, source) if r[0] == "route"}


@pytest.mark.parametrize(
    "name, path, source, want",
    [
        ("express", "a.ts", "app.get('/x', h);\n// app.get('/ghost', h)\nconst s = \"app.get('/no', h)\";\nrouter.post('/y', mw, h2);\napp.get('view engine');", {("GET", "/x"), ("POST", "/y")}),
        ("fastify", "a.ts", "fastify.get('/x', h);\napp.on('GET', '/z', h);", {("GET", "/x"), ("GET", "/z")}),
        ("fastapi", "a.py", "@app.get('/items/{id}')\nasync def item(id: int):\n    pass\n# @app.get('/ghost')\n", {("GET", "/items/{id}")}),
        ("nestjs", "a.ts", "@Controller('cats')\nexport class Cats {\n  @Get(':id')\n  one() {}\n  @Post()\n  make() {}\n}\n", {("GET", "/cats/:id"), ("POST", "/cats")}),
        ("rails", "config/routes.rb", "get '/ping', to: 'health#ping'\nroot 'home#index'\n", {("GET", "/ping"), ("GET", "/")}),
        ("laravel", "routes/web.php", "<?php\nRoute::get('/u', [UserController::class, 'index']);\nRoute::any('/a', 'X@y');\n", {("GET", "/u"), ("ANY", "/a")}),
        ("spring", "A.java", "@RequestMapping(\"/api\")\nclass A {\n  @GetMapping(\"/x\")\n  public String x() { return \"\"; }\n}\n", {("GET", "/api/x")}),
        ("golang", "a.go", "func main() {\n\thttp.HandleFunc(\"/x\", h)\n\tr.POST(\"/y\", g)\n}\n", {("GET", "/x"), ("POST", "/y")}),
        ("django", "urls.py", "from django.urls import path\nurlpatterns = [path('users/', views.users)]\n", {(None, "/users/")}),
    ],
)
def test_routes(name, path, source, want):
    got = routes(name, path, source)
    strip = lambda rows: {(m, p.strip("/")) for m, p in rows}
    assert strip(got) == strip(want)


def test_resources_have_seven_routes():
    assert len([r for r in frameworks.rails("config/routes.rb", "resources :orders\n") if r[0] == "route"]) == 7


def test_models():
    assert [r[2] for r in frameworks.prisma("schema.prisma", "model User {\n id Int\n}\n// model Ghost {\n")] == ["User"]


def test_next_paths():
    assert frameworks.app_route("app/(shop)/orders/[id]/route.ts") is not None
    assert frameworks.pages_route("pages/api/users.ts") is not None


def test_python_symbols():
    source = '"""doc"""\nimport os\nfrom a.b import c as d\n\nclass A(B):\n    """about A"""\n    def f(self, x: Item) -> Other:\n        return g(x)\n\ndef g(x):\n    # h()\n    return "h()"\n'
    rows = syntax.read("m.py", "python", source)
    symbols = {(r[1], r[2]) for r in rows if r[0] == "symbol"}
    assert {("A", "class"), ("f", "method"), ("g", "function")} <= symbols
    relations = {(r[3], r[1], r[4]) for r in rows if r[0] == "relation"}
    assert ("A", "EXTENDS", "B") in relations and ("f", "CALLS", "g") in relations and ("f", "PARAM_TYPE", "Item") in relations and ("f", "RETURN_TYPE", "Other") in relations
    assert not any(t == "h" for _, _, t in relations)
    assert ("d", "a.b") in {(r[1], r[4]) for r in rows if r[0] == "import"}


def test_script_symbols():
    source = "import X, { y as z } from './m';\nexport class A extends B implements C {\n  run(p: Item): Out { return z(p); }\n}\nexport const f = (a) => A.make(a);\n/* function ghost() {} */\ntype T = string;\n"
    rows = syntax.read("m.ts", "typescript", source)
    symbols = {r[1] for r in rows if r[0] == "symbol"}
    assert {"A", "run", "f", "T"} <= symbols and "ghost" not in symbols
    relations = {(r[3], r[1], r[4]) for r in rows if r[0] == "relation"}
    assert {("A", "EXTENDS", "B"), ("A", "IMPLEMENTS", "C"), ("run", "CALLS", "z")} <= relations
    assert {"X", "z"} <= {r[1] for r in rows if r[0] == "import"}


@pytest.mark.parametrize("language, path, source, names", [("go", "a.go", "package a\nfunc Run(x int) int { return x }\ntype S struct {}\n", {"Run", "S"}), ("java", "A.java", "public class A {\n  public int run(int x) { return x; }\n}\n", {"A", "run"}), ("rust", "a.rs", "pub fn run(x: i32) -> i32 { x }\nstruct S { a: i32 }\n", {"run", "S"}), ("php", "a.php", "<?php\nclass A {\n  public function run() {}\n}\n", {"A", "run"}), ("ruby", "a.rb", "class A\n  def run\n  end\nend\n", {"A", "run"})])
def test_other_languages(language, path, source, names):
    assert names <= {r[1] for r in syntax.read(path, language, source) if r[0] == "symbol"}


def test_client_calls():
    source = "fetch('/api/a');\nfetch(`/api/b/${id}`, { method: 'POST' });\naxios.put('/api/c', x);\n// fetch('/api/ghost')\n"
    assert {(m, r) for m, r, _ in api_calls.calls(source)} == {("GET", "/api/a"), ("POST", "/api/b/${id}"), ("PUT", "/api/c")}


def test_broken_sources_give_nothing():
    assert syntax.read("a.py", "python", "def (:\n") == []
    for name, (_, reader) in frameworks.REGISTRY.items():
        list(reader("a.py", "'''unclosed ( [ {"))
