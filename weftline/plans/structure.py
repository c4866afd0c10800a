"""Rules over the structure of classes: their fields, methods, annotations, supertypes and imports.

Frames (whoever parses sources fills them; further columns are ignored):

* classes: id, name, kind (STATELESS, STATEFUL, ENTITY, MESSAGE_DRIVEN, SINGLETON or null),
  is_interface, annotations, supertypes, imports (arrays), private_constructor
* fields: id (of the class), name, type, is_static, is_final, annotations
* methods: id, name, return_type, is_static, is_public, is_synchronized, annotations

Rules of single fields and methods are one projection each. Rules of a class aggregate
its fields and methods by id, partially before the shuffle. Null names, types and arrays
match nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and words that the rules look for.
RESOURCE_ANNOTATIONS = ("Resource", "EJB", "Inject", "Autowired")
SECURITY_ANNOTATIONS = ("RolesAllowed", "PermitAll", "DenyAll", "DeclareRoles", "RunAs")
SECURING_ANNOTATIONS = ("RolesAllowed", "DeclareRoles", "RunAs", "PermitAll", "DenyAll", "Secured", "PreAuthorize", "PostAuthorize", "RolesRequired")
LIFECYCLE_ANNOTATIONS = ("PostConstruct", "PreDestroy", "PostActivate", "PrePassivate")
LIFECYCLE_METHODS = ("ejbCreate", "ejbRemove", "ejbActivate", "ejbPassivate", "ejbLoad", "ejbStore", "setSessionContext", "setEntityContext", "setMessageDrivenContext")
KIND_SCORES = {"STATELESS": 1, "STATEFUL": 3, "ENTITY": 4, "MESSAGE_DRIVEN": 2, "SINGLETON": 2}
CONFIG_CLASSES = ("Constants", "Config", "Properties", "Settings", "Params", "Options", "Configuration", "Parameter", "Property")
CONFIG_FIELDS = ("URL", "HOST", "PORT", "PATH", "ENDPOINT", "TIMEOUT", "SIZE", "MAX", "MIN", "DEFAULT", "ENABLED", "DISABLED", "MODE", "FORMAT", "SERVER", "SERVICE", "CONNECTION", "RETRY", "BUFFER", "CACHE", "THRESHOLD")
CACHE_CLASSES = ("Cache", "Singleton", "Registry", "Manager", "Store", "Pool", "Buffer", "Holder")
SECURITY_CLASSES = ("Security", "Auth", "Permission", "Access", "Principal", "Role", "User")
SECURITY_METHODS = ("security", "auth", "permission", "role", "access", "principal", "login", "logout", "credential")
INTERCEPTOR_CLASSES = ("Interceptor", "Aspect", "Advice", "Handler", "Wrapper", "Filter", "Chain", "Security", "Logging", "Audit", "Transaction", "Metrics")
INTERCEPTOR_ANNOTATIONS = (
    "Interceptor", "AroundInvoke", "AroundTimeout", "AroundConstruct", "PostConstruct", "PreDestroy", "PrePassivate", "PostActivate", "ClientInterceptor", "ServerInterceptor", "Interceptors",
    "WLInterceptor", "WLInvocationInterceptor", "WSInterceptor", "WSCallbackInterceptor", "Aspect", "Pointcut", "Before", "After", "Around",
)
INTERCEPTOR_IMPORTS = ("javax.interceptor", "javax.ejb.AroundInvoke", "javax.annotation.PostConstruct", "javax.annotation.PreDestroy", "javax.ejb.PostActivate", "javax.ejb.PrePassivate", "org.jboss.aspects", "weblogic.ejb.interceptor", "com.ibm.websphere.ejbcontainer.interceptor")
INTERCEPTOR_METHODS = ("invoke", "intercept", "advice", "around", "before", "after")
INSTANCE_METHODS = ("getInstance", "instance", "get", "create")
#: role: annotations, supertypes, whether it is an interface
ROLES = {
    "session": (("Stateless", "javax.ejb.Stateless", "Stateful", "javax.ejb.Stateful"), ("SessionBean", "javax.ejb.SessionBean"), False),
    "entity": (("Entity", "javax.persistence.Entity"), ("EntityBean", "javax.ejb.EntityBean"), False),
    "message_driven": (("MessageDriven", "javax.ejb.MessageDriven"), ("MessageDrivenBean", "javax.ejb.MessageDrivenBean"), False),
    "remote_home": ((), ("EJBHome", "javax.ejb.EJBHome"), True),
    "local_home": ((), ("EJBLocalHome", "javax.ejb.EJBLocalHome"), True),
    "remote": ((), ("EJBObject", "javax.ejb.EJBObject"), True),
    "servlet": ((), ("HttpServlet", "javax.servlet.http.HttpServlet", "GenericServlet", "javax.servlet.GenericServlet"), False),
}
RESOURCE_PATTERNS = {
    "datasource": "(?i)(data-source|datasource|connection-pool|resource-ref)",
    "jndi": "(?i)(jndi-name|lookup-name|java:/?comp/env|java:/?jboss)",
    "pool": "(?i)(min-pool-size|max-pool-size|pool-size|initial-capacity|max-capacity)",
    "vendor": "(?i)(jboss|wildfly|driver-class|connection-url|xa-datasource)",
}
LEGACY_FILES = {
    "ejb_deployment_descriptor": ("ejb-jar.xml", "persistence.xml", "orm.xml", "jboss.xml", "jbosscmp-jdbc.xml", "weblogic-ejb-jar.xml", "websphere-ejb-jar.xml", "sun-ejb-jar.xml", "glassfish-ejb-jar.xml"),
    "struts_configuration": ("struts-config.xml", "validation.xml", "validator-rules.xml", "tiles-defs.xml", "struts.properties"),
    "hibernate_configuration": ("hibernate.cfg.xml", "hibernate.properties", "ehcache.xml"),
    "spring_legacy_configuration": ("applicationContext.xml", "spring-servlet.xml", "spring-beans.xml", "spring.xml"),
    "jsf_configuration": ("faces-config.xml", "navigation.xml"),
    "axis_webservice": ("server-config.wsdd", "client-config.wsdd", "deploy.wsdd", "undeploy.wsdd"),
    "log4j_configuration": ("log4j.xml", "log4j.properties"),
    "connection_pool_configuration": ("c3p0.properties", "dbcp.properties"),
    "legacy_build_configuration": ("build.properties", "project.xml", "maven.xml"),
    "web_framework_configuration": ("tapestry.xml", "velocity.properties", "freemarker.properties"),
    "security_framework_configuration": ("acegi-security.xml", "security.xml"),
}


def _has(words: Iterable[str], text: Column) -> Column:
    """Whether the text holds any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return F.coalesce(out, F.lit(False))


def _any(names: Iterable[str], array: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(array), F.array(*map(F.lit, names)).cast("array<string>")), F.lit(False)) if names else F.lit(False)


def _any_has(words: Iterable[str], array: str) -> Column:
    return F.coalesce(F.exists(array, lambda x: _has(words, x)), F.lit(False))


def _rows(df: DataFrame, *rules: tuple[Column, str, str, str]) -> DataFrame:
    """(id, type, severity, location, advice) of every rule (condition, type, severity, advice) that a row meets."""
    hits = F.array(*(F.when(c, F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(a).alias("advice"))) for c, t, s, a in rules))
    return df.select("id", "location", F.explode(F.array_compact(hits)).alias("hit")).select("id", "hit.type", "hit.severity", "location", "hit.advice")


def anti_patterns(classes: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(id, type, severity, location, advice): mutable state, factories, unsafe collections, caches, resources, lookups and threads."""
    name, kind = F.col("name"), F.col("type")
    stateless = classes.filter("kind = 'STATELESS'").select("id")
    allowed = _has(("Logger", "EntityManager"), kind) | _any(("Inject",), "annotations") & kind.contains("Event")
    f = fields.withColumn("location", F.concat(F.lit("field:"), name))
    state = _rows(f.join(stateless, "id", "left_semi"), (~F.col("is_final") & ~F.col("is_static") & ~allowed, "MUTABLE_STATE_IN_STATELESS_BEAN", "HIGH", "Convert to constructor injection or make final"))
    of_fields = _rows(
        f,
        (_has(("HashMap", "ArrayList", "HashSet"), kind) & ~F.col("is_final") & ~_any(("Inject",), "annotations"), "NON_THREAD_SAFE_COLLECTION", "HIGH", "Use ConcurrentHashMap or make thread-safe"),
        (kind.contains("Cache") | F.lower(name).contains("cache"), "CACHING_IN_STATELESS_BEAN", "HIGH", "Use Spring Cache abstraction with proper scope"),
        (kind.contains("DataSource") & ~_any(RESOURCE_ANNOTATIONS, "annotations"), "UNINJECTED_RESOURCE", "MEDIUM", "Use @Autowired to inject DataSource"),
    )
    lower = F.lower(name)
    of_methods = _rows(
        methods.withColumn("location", F.concat(F.lit("method:"), name)),
        (lower.rlike("^(create|get|build)") & F.col("is_static") & (F.col("return_type") != "void"), "FACTORY_METHOD", "MEDIUM", "Move to @Configuration class with @Bean methods"),
        (_has(("Connection", "Statement", "ResultSet"), name), "MANUAL_RESOURCE_MANAGEMENT", "MEDIUM", "Use Spring's JdbcTemplate or proper resource management"),
        (_has(("lookup", "jndi"), lower), "JNDI_LOOKUP", "HIGH", "Replace with Spring dependency injection"),
    )
    of_classes = _rows(
        classes.withColumn("location", F.lit("class")),
        (_any_has(("javax.naming", "InitialContext"), "imports"), "JNDI_LOOKUP", "HIGH", "Replace with Spring dependency injection"),
        (_any_has(("java.util.concurrent", "Thread", "Executor"), "imports"), "THREAD_MANAGEMENT", "HIGH", "Use Spring's @Async or proper thread pool management"),
    )
    return state.unionByName(of_fields).unionByName(of_methods).unionByName(of_classes)


def _level(score: Column, low: int, medium: int) -> Column:
    return F.when(score <= low, "LOW").when(score <= medium, "MEDIUM").otherwise("HIGH")


def migration_complexity(classes: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """id, score and level: the kind's points, injected beans and resources, 1 for security, and lifecycle methods."""
    f = fields.groupBy("id").agg(F.sum(_any(("EJB",), "annotations").cast("int") + _any(("Resource",), "annotations").cast("int")).alias("dependencies"))
    lifecycle = _any(LIFECYCLE_ANNOTATIONS, "annotations").cast("int") + F.coalesce(F.col("name").isin(*LIFECYCLE_METHODS), F.lit(False)).cast("int")
    m = methods.groupBy("id").agg(F.sum(lifecycle).alias("lifecycle"), F.bool_or(_any(SECURITY_ANNOTATIONS, "annotations")).alias("secured"))
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in KIND_SCORES.items() for x in kv))[F.col("kind")], F.lit(0))
    none = F.lit(0)
    score = kind + F.coalesce("dependencies", none) + (_any(SECURITY_ANNOTATIONS, "annotations") | F.coalesce("secured", F.lit(False))).cast("int") + F.coalesce("lifecycle", none)
    return classes.join(f, "id", "left").join(m, "id", "left").select("id", score.cast("long").alias("score"), _level(score, 3, 7).alias("level"))


def data_transfer_score() -> Column:
    """Points of a class by its features is_dto, fields, value_object, immutable, mapping_methods, row_mappings, row_calls and jdbc."""
    c = F.col
    tier = lambda x, *steps: F.coalesce(*(F.when(c(x) > n, p) for n, p in steps), F.lit(0))
    dto = F.when(c("is_dto") > 0, 1 + tier("fields", (10, 2), (5, 1))).otherwise(0)
    value = F.when(c("value_object") > 0, 1 + tier("immutable", (0, 1))).otherwise(0)
    mapping = F.when(c("mapping_methods") > 0, 2 + tier("mapping_methods", (3, 1))).otherwise(0)
    rows = F.when(c("row_mappings") > 0, 2 + tier("row_calls", (10, 2), (5, 1))).otherwise(0)
    return dto + value + mapping + rows + tier("jdbc", (0, 1))


def data_transfer(features: DataFrame) -> DataFrame:
    """id, score and level of classes that carry or map data."""
    d = features.filter("is_dto + value_object + mapping_methods + row_mappings > 0").withColumn("score", data_transfer_score())
    return d.select("id", "score", _level(F.col("score"), 3, 7).alias("level"))


def config_constants(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """id, constant_share and name_share of classes that hold configuration constants."""
    constant = F.col("is_static") & F.col("is_final")
    named = constant & _has(CONFIG_FIELDS, F.upper("name"))
    f = fields.groupBy("id").agg(F.count("*").alias("n"), (F.count_if(constant) / F.count("*")).alias("constant_share"), (F.count_if(named) / F.count("*")).alias("name_share"))
    d = classes.select("id", "name").join(f, "id")
    share, names = F.col("constant_share"), F.col("name_share")
    fires = (share >= 0.8) & (F.col("n") >= 3) | _has(CONFIG_CLASSES, F.col("name")) & (share >= 0.5) | (names > 0.4) & (share >= 0.7)
    return d.filter(fires).select("id", "constant_share", "name_share")


def cache_singletons(classes: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """id, static_fields and target (singleton, cache or null) of classes that keep state for all: static fields, instance getters, or a telling name with a private constructor."""
    f = fields.groupBy("id").agg(F.count_if(F.col("is_static")).alias("static_fields"))
    getter = F.col("is_static") & F.col("name").startswith("get") & F.col("name").contains("Instance")
    m = methods.groupBy("id").agg(F.bool_or(getter).alias("getter"))
    d = classes.join(f, "id", "left").join(m, "id", "left").select("id", F.coalesce("static_fields", F.lit(0)).alias("static_fields"), F.coalesce("getter", F.lit(False)).alias("getter"), (_has(CACHE_CLASSES, F.col("name")) & F.col("private_constructor")).alias("named"))
    target = F.when(F.col("getter"), "singleton").when(F.col("static_fields") > 1, "cache")
    return d.filter("static_fields > 0 or getter or named").select("id", "static_fields", target.alias("target"))


def singletons(classes: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """id of classes with a private constructor and a static field of their own type or a public static instance method that returns it."""
    own = classes.filter("private_constructor").select("id", F.col("name").alias("own"))
    of_fields = fields.filter("is_static").join(own, "id").filter("type = own").select("id")
    of_methods = methods.filter(F.col("is_static") & F.col("is_public") & F.col("name").isin(*INSTANCE_METHODS)).join(own, "id").filter("return_type = own").select("id")
    return of_fields.union(of_methods).distinct()


def security_facades(classes: DataFrame, methods: DataFrame, uses: Column | None = None) -> DataFrame:
    """id and security_methods of classes that use security APIs (`uses`, a column of classes) or have a telling name and security methods or annotations."""
    telling = _has(SECURITY_METHODS, F.lower("name"))
    m = methods.groupBy("id").agg(F.count_if(telling).alias("security_methods"), F.count_if(_any(SECURING_ANNOTATIONS, "annotations")).alias("secured"))
    d = classes.select("id", "name", (F.lit(False) if uses is None else F.coalesce(uses, F.lit(False))).alias("uses")).join(m, "id", "left")
    d = d.fillna(0, ["security_methods", "secured"])
    return d.filter(F.col("uses") | _has(SECURITY_CLASSES, F.col("name")) & ((F.col("security_methods") > 0) | (F.col("secured") > 0))).select("id", "security_methods")


def interceptors(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """id of interceptors: by annotation, import, around or lifecycle method, or a telling name with an interceptor method."""
    around = F.coalesce(F.exists("annotations", lambda x: x.contains("AroundInvoke")), F.lit(False))
    callback = _any((*LIFECYCLE_ANNOTATIONS, "AroundConstruct"), "annotations")
    m = methods.groupBy("id").agg(F.bool_or(around | callback).alias("marked"), F.bool_or(around | _has(INTERCEPTOR_METHODS, F.col("name"))).alias("methods"))
    d = classes.join(m, "id", "left")
    named = _has(INTERCEPTOR_CLASSES, F.col("name")) & F.coalesce("methods", F.lit(False))
    return d.filter(F.coalesce("marked", F.lit(False)) | _any(INTERCEPTOR_ANNOTATIONS, "annotations") | _any_has(INTERCEPTOR_IMPORTS, "imports") | named).select("id")


def roles(classes: DataFrame) -> DataFrame:
    """(id, role, version): beans, homes, remotes and servlets by annotations (3.x) and supertypes (2.x)."""
    hits = []
    for role, (annotations, supertypes, interface) in ROLES.items():
        by_annotation = _any(annotations, "annotations")
        fires = (F.col("is_interface") == interface) & (by_annotation | _any(supertypes, "supertypes"))
        hits.append(F.when(fires, F.struct(F.lit(role).alias("role"), F.when(by_annotation, "3.x").otherwise("2.x").alias("version"))))
    return classes.select("id", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("id", "hit.role", "hit.version")


def resource_settings(files: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """id and how often each of the four resource patterns stands in the text."""
    return files.select(F.col(id_col).alias("id"), *(F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)).alias(name) for name, p in RESOURCE_PATTERNS.items()))


def legacy_files(files: DataFrame, name: str = "name", id_col: str = "id") -> DataFrame:
    """(id, framework) of files that have a framework's file name, the case included."""
    framework = F.coalesce(*(F.when(F.col(name).isin(*names), what) for what, names in LEGACY_FILES.items()))
    return files.select(F.col(id_col).alias("id"), framework.alias("framework")).filter("framework is not null")


def server_files(files: DataFrame, name: str = "name", id_col: str = "id") -> DataFrame:
    """id, server (null: any) and what a server's configuration file sets, by its lower-case name."""
    n = F.lower(name)
    server = (
        F.when(n.isin("server.xml", "context.xml", "tomcat-users.xml"), "tomcat")
        .when(n.startswith("weblogic") | (n == "config.xml"), "weblogic")
        .when(n.startswith("ibm-"), "websphere")
        .when(n.startswith("glassfish-") | n.startswith("sun-"), "glassfish")
        .when(n.startswith("orion-") | (n == "data-sources.xml"), "oracle")
    )
    what = (
        F.when(_has(("security", "jaas", "ssl", "auth"), n), "security")
        .when(_has(("data-source", "datasource"), n) | n.endswith("-ds.xml"), "datasource")
        .when(_has(("jms", "activemq", "rabbit", "messaging"), n), "messaging")
        .when(n.contains("web") & n.endswith(".xml"), "web")
    )
    # wildcard names, and the listed ones that no wildcard covers
    known = n.rlike(r"(-web|ejb-jar|-application|-bnd|-ext|-ds)\.xml$|\.(properties|conf|config)$|^(server|context).*\.xml$") | n.isin("tomcat-users.xml", "weblogic.xml", "config.xml", "data-sources.xml", "security-policy.xml", "jms.xml", "activemq.xml")
    return files.filter(known).select(F.col(id_col).alias("id"), server.alias("server"), what.alias("sets"))


_BEAN = "struct<`ejb-name`: string, `ejb-class`: string, home: string, remote: string, `local-home`: string, local: string>"
DESCRIPTOR = f"`enterprise-beans` struct<session: array<{_BEAN}>, entity: array<{_BEAN}>, `message-driven`: array<{_BEAN}>>"


def descriptor_beans(files: DataFrame, text: str = "text") -> DataFrame:
    """The beans of deployment descriptors: bean_type, name, bean_class and the four interfaces; texts that are no XML have none."""
    d = files.select(F.from_xml(F.col(text), DESCRIPTOR)["enterprise-beans"].alias("b"))

    def of_kind(kind: str) -> Column:
        return F.transform(F.coalesce(F.col("b")[kind], F.array().cast(f"array<{_BEAN}>")), lambda x: F.struct(F.lit(kind).alias("bean_type"), x.alias("x")))

    all_beans = F.concat(*map(of_kind, ("session", "entity", "message-driven")))
    x = d.select(F.explode(all_beans).alias("e")).select("e.bean_type", "e.x.*")
    return x.select("bean_type", F.col("ejb-name").alias("name"), F.col("ejb-class").alias("bean_class"), "home", "remote", F.col("local-home").alias("local_home"), "local")


def descriptor_edges(beans: DataFrame) -> DataFrame:
    """Edges of each bean class to its interfaces, by their part and as `implements`."""
    ends = F.array(*(F.struct(F.trim(c).alias("target_id"), F.lit(f"ejb_{c}").alias("edge_type")) for c in ("home", "remote", "local_home", "local")))
    e = beans.select(F.col("bean_class").alias("source_id"), F.explode(ends).alias("e")).select("source_id", "e.target_id", "e.edge_type").filter("source_id is not null and target_id != ''")
    return e.union(e.select("source_id", "target_id", F.lit("implements"))).distinct()


def substitute(template: Column, values: Column) -> Column:
    """The template with each ${name} replaced by the map's value; null where a name has none. Values are not read again."""
    parts = F.split(template, r"\$\{")
    head, tails = F.element_at(parts, 1), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    # a tail without an end of its name is text
    filled = F.transform(tails, lambda t: _filled(t, values))
    return F.concat(head, F.when(F.exists(filled, lambda x: x.isNull()), F.lit(None).cast("string")).otherwise(F.array_join(filled, "")))


def _filled(tail: Column, values: Column) -> Column:
    at = F.instr(tail, "}")
    return F.when(at == 0, F.concat(F.lit("${"), tail)).otherwise(F.concat(F.element_at(values, F.trim(tail.substr(F.lit(1), at - 1))), tail.substr(at + 1, F.length(tail))))
