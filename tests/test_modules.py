"""Import extraction and resolution, language by language."""

from quarry.operators import graph, modules

FILES = {
    "app/main.py": "import utils, os.path as p\nfrom .models import User\nfrom ..shared import x\nfrom . import y\n",
    "app/utils.py": "", "app/models.py": "", "shared/__init__.py": "", "app/__init__.py": "", "lib/tool.py": "", "src/use.py": "import tool\n",
    "web/app.ts": "import { a } from './lib/greet';\nimport 'x/side';\nconst r = require(\"../up\");\nawait import('@/page');\nexport * from './lib';\nimport q from '/abs/z.js';\n",
    "web/lib/greet.ts": "", "up.jsx": "", "src/page.tsx": "", "web/lib/index.js": "", "abs/z.ts": "",
    "main.go": 'package m\nimport "fmt"\nimport (\n  "example.com/m/store"\n  x "other.org/kit"\n)\n', "store/a.go": "", "store/b.go": "", "kit.go": "",
    "A.java": "import com.x.B;\nimport static com.x.C;\nimport com.none.D;\n", "src/main/java/com/x/B.java": "", "com/x/C.kt": "",
    "crates/one-a/Cargo.toml": "", "crates/one-a/src/deep/leaf.rs": "", "crates/two/src/only.rs": "",
    "src/lib.rs": "mod parts;\npub(crate) mod helper;\nuse crate::parts::{a, b};\nuse one_a::deep::leaf::Item;\nuse super::helper;\nuse only::f;\n",
    "src/parts/mod.rs": "", "src/helper.rs": "",
    "run.rb": "require 'thing'\nrequire_relative './near'\nload \"full.rb\"\n", "lib/thing.rb": "", "near.rb": "", "app/full.rb": "",
    "x/m.c": '#include "m.h"\n# include <inc.h>\n#include <stdio.h>\n', "x/m.h": "", "include/inc.h": "",
    "p/i.php": "use App\\Model;\nrequire_once 'part.php';\n", "src/App/Model.php": "", "p/part.php": "",
    "S.cs": "using Deep.Name;\nusing static Other.Last;\n", "Deep/Name.cs": "", "Last.cs": "",
    "bin/d.dart": "import 'package:me/core.dart';\nimport 'dart:io';\nexport 'peer.dart';\n", "lib/core.dart": "", "bin/peer.dart": "",
    "t.kt": "import com.x.B as Q\n", "u.scala": "import a.b.C\n", "v.swift": "import struct Kit.Part\n", "w.scss": "@import url('base.css');\n@import \"x\";\n",
}
WANT = {
    "app/main.py": {"utils": "app/utils.py", "os.path": None, ".models": "app/models.py", "..shared": "shared/__init__.py", ".": "app/__init__.py"},
    "src/use.py": {"tool": "lib/tool.py"},
    "web/app.ts": {"./lib/greet": "web/lib/greet.ts", "x/side": None, "../up": "up.jsx", "@/page": "src/page.tsx", "./lib": "web/lib/index.js", "/abs/z.js": "abs/z.ts"},
    "main.go": {"fmt": None, "example.com/m/store": "store/a.go", "other.org/kit": "kit.go"},
    "A.java": {"com.x.B": "src/main/java/com/x/B.java", "com.x.C": "com/x/C.kt", "com.none.D": None},
    "src/lib.rs": {"parts": "src/parts/mod.rs", "helper": "src/helper.rs", "crate::parts::a": "src/parts/mod.rs", "crate::parts::b": "src/parts/mod.rs",
                   "one_a::deep::leaf::Item": "crates/one-a/src/deep/leaf.rs", "super::helper": "src/helper.rs", "only::f": "crates/two/src/only.rs"},
    "run.rb": {"thing": "lib/thing.rb", "./near": "near.rb", "full.rb": "app/full.rb"},
    "x/m.c": {"m.h": "x/m.h", "inc.h": "include/inc.h", "stdio.h": None},
    "p/i.php": {"App\\Model": "src/App/Model.php", "part.php": "p/part.php"},
    "S.cs": {"Deep.Name": "Deep/Name.cs", "Other.Last": "Last.cs"},
    "bin/d.dart": {"package:me/core.dart": "lib/core.dart", "peer.dart": "bin/peer.dart"},
    "t.kt": {"com.x.B": "src/main/java/com/x/B.java"},
    "u.scala": {"a.b.C": None}, "v.swift": {"Kit.Part": None}, "w.scss": {"base.css": None, "x": None},
}


def frame(spark, files):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files.items())], "id long, relative_path string, content string")


def test_all_languages(spark):
    files = frame(spark, FILES)
    rows = modules.resolve(modules.extract(files), files, go_module="example.com/m").collect()
    got = {}
    for r in rows:
        got.setdefault(r.relative_path, {})[r.raw_import] = r.target
    assert got == WANT


def test_blast_radius_of_a_project(spark):
    py = frame(spark, {"main.py": "import utils\n", "utils.py": "import models\n", "models.py": "x = 1\n"})
    ts = frame(spark, {"app.ts": "import {a} from './lib/greet'", "lib/greet.ts": "import u from './user';", "lib/user.ts": ""})
    for files, root, want in ((py, "models.py", [("utils.py", 1), ("main.py", 2)]), (ts, "lib/user.ts", [("lib/greet.ts", 1), ("app.ts", 2)])):
        got = graph.reach(modules.import_edges(files), spark.createDataFrame([(root,)], "root string"), 3)
        assert [(r.node, r.depth) for r in got.orderBy("depth").collect()] == want


def test_imports_of_test_sections_make_no_cycles(spark):
    files = frame(spark, {
        "src/a.rs": "use crate::b::x;\n", "src/b.rs": "fn f() {}\n#[cfg(test)]\nmod tests {\n    use crate::a::y;\n}\n",
        "src/c.rs": "use crate::d::x;\n", "src/d.rs": "use crate::c::y;\nuse super::tools;\n", "src/tools.rs": "", "tools.rs": "",
    })
    cycles = lambda **more: {r.node for r in graph.cycles(modules.import_edges(files, **more)).collect()}
    assert cycles() == {"src/a.rs", "src/b.rs", "src/c.rs", "src/d.rs"} and cycles(tests=False) == {"src/c.rs", "src/d.rs"}
