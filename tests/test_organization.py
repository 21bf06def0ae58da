"""Placement and layer rules, one by one."""

from cairnspark.functions.text import line_table
from cairnspark.operators import organization as org

LONG = 'let a = "a rather long literal";'
FILES = {
    "crates/domain/src/order.rs": "pub trait PayGateway {\n}\nimpl Order {\n    pub fn new() -> Self { x }\n    pub fn ship(&self) {\n        go();\n    }\n    fn is_open(&self) -> bool { y }\n}\n#[cfg(test)]\nmod tests {\n    impl Order { fn extra(&self) {} }\n}\n",
    "crates/domain/src/ports/pay.rs": "pub trait PayGateway {}\nimpl Pay { fn run(&self) {} }\n",
    "crates/domain/src/adapters/db.rs": LONG,
    "crates/infrastructure/src/ports/db.rs": f"{LONG}\nimpl OrderRepository for Db {{\n}}\n",
    "crates/infrastructure/src/cache/my_config.rs": LONG,
    "crates/infrastructure/src/a/b/error.rs": "use crate::server::state;\n// use crate::server::x;\n",
    "crates/app/src/infrastructure/net.rs": "use crate::server::state;\npub use crate::server::other;\n" + LONG,
    "crates/app/src/server/mod.rs": "pub struct PageHandler {}\nlet s = Arc::new(OrderService::new(db));\npub trait OrderService {}\npub trait OrderServiceExt {}\npub trait CacheProvider {}\ntrait SecretService {}\n",
    "crates/app/src/server/builder.rs": "let s = Arc::new(OrderService::new(db));\n",
    "crates/app/src/server/handlers/page.rs": "pub struct PageHandler {}\nlet n = 123456; let m = 86400; let k = 99999;\nconst X: u32 = 777777;\n",
    "crates/app/src/constants.rs": "let n = 555555;\n" + LONG,
    "crates/app/tests/a.rs": "let n = 444444;\n" + LONG,
    "crates/app/src/config.rs": "",
}


def test_each_rule(spark):
    lines = line_table(spark.createDataFrame(list(FILES.items()), "file string, content string"))
    got = {(r.id, r.file.removeprefix("crates/"), r.line, r.message.split(": ")[-1].split(" ")[-1]) for r in org.organization_findings(lines).collect()}
    assert got == {
        ("ORG001", "app/src/server/handlers/page.rs", 2, "123456"), ("ORG001", "app/src/server/handlers/page.rs", 2, "99999"),
        ("ORG002", "app/src/infrastructure/net.rs", None, "literal"),
        ("ORG005", "domain/src/adapters/db.rs", None, "infrastructure"), ("ORG005", "infrastructure/src/ports/db.rs", None, "domain"),
        ("ORG005", "infrastructure/src/cache/my_config.rs", None, "scattered"), ("ORG005", "infrastructure/src/a/b/error.rs", None, "scattered"),
        ("ORG007", "app/src/server/mod.rs", 3, "OrderService"),
        ("ORG013", "app/src/server/mod.rs", 2, "OrderService"),
        ("ORG014", "app/src/infrastructure/net.rs", 1, "layer"), ("ORG014", "infrastructure/src/a/b/error.rs", 1, "layer"),
        ("ORG015", "infrastructure/src/ports/db.rs", 2, "Db"),
        ("ORG016", "domain/src/order.rs", 5, "domain"),
        ("ORG017", "app/src/server/mod.rs", 1, "PageHandler"),
        ("ORG018", "domain/src/order.rs", 1, "PayGateway"),
    }


def test_no_files(spark):
    assert org.organization_findings(line_table(spark.createDataFrame([], "file string, content string"))).collect() == []
