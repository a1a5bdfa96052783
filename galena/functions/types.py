"""Type names taken out of written types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that bind to no definition, generics whose argument counts, nullable wrappers, absent types.
PRIMITIVES = "string number boolean void int float double long short byte char bool str i8 i16 i32 i64 u8 u16 u32 u64 f32 f64 usize isize undefined null None nil".split()
WRAPPERS = "Promise Observable Future CompletableFuture Task ValueTask Option Some Optional Maybe Result Either Rc Arc Weak MutexGuard RwLockReadGuard RwLockWriteGuard Ref RefMut Cow".split()
NULLABLE = ("Optional", "Option", "Maybe")
ABSENT = ("null", "undefined", "void", "None", "nil")
# Containers of keys and values, of single elements, and the methods that give keys.
KEYED = "Map WeakMap HashMap BTreeMap LinkedHashMap TreeMap dict Dict Dictionary SortedDictionary Record OrderedDict ConcurrentHashMap ConcurrentDictionary MutableMap".split()
KEY_METHODS = ("keys", "keySet", "Keys")
#: Wrappers within wrappers that are taken off.
DEPTH = 5


def _balanced_first(args: Column) -> Column:
    """The first argument of a list of type arguments, brackets within counted, lifetimes left out."""
    clean = F.regexp_replace(args, r"^(?:\s*'\w+\s*,)+", "")
    # an argument: no comma outside up to three levels of brackets
    part = r"^\s*((?:[^,<>\[\]]|[<\[](?:[^<>\[\]]|[<\[](?:[^<>\[\]]|[<\[][^<>\[\]]*[>\]])*[>\]])*[>\]])*)"
    return F.trim(F.regexp_extract(clean, part, 1))


def _plain(text: Column) -> Column:
    """Without pointer and reference signs, a nullable mark, and the absent types of a union; a union of several is null."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[&*]+\s*(?:mut\s+)?", ""), r"\?$", "")
    parts = F.filter(F.transform(F.split(t, r"\|"), lambda p: F.trim(p)), lambda p: ~p.isin(*ABSENT))
    return F.when(~t.contains("|"), t).when(F.size(parts) == 1, F.get(parts, F.lit(0)))


def _last_name(text: Column) -> Column:
    return F.element_at(F.split(text, r"::|[.\\]"), -1)


def return_type(raw: Column) -> Column:
    """The definition that a written return type binds to: wrappers taken off, the base of other generics, the last part of a qualified name; null for primitives."""
    generic = r"^(\w+)\s*<(.+)>$"

    def unwrap(text: Column, _) -> Column:
        return F.when(F.regexp_extract(text, generic, 1).isin(*WRAPPERS), _plain(_balanced_first(F.regexp_extract(text, generic, 2)))).otherwise(text)

    def named(text: Column) -> Column:
        base, name = F.regexp_extract(text, generic, 1), _last_name(text)
        free = ~text.isin(*WRAPPERS) & ~name.isin(*PRIMITIVES) & ~F.lower(name).isin(*PRIMITIVES) & name.rlike(r"^[A-Z_]\w*$") & (F.length(name) <= 512)
        return F.when(base != "", F.when(~F.lower(base).isin(*PRIMITIVES), base)).when(free, name)

    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), _plain(raw), unwrap, named)


def element_type(raw: Column, last: bool = True) -> Column:
    """The element of a written container: of an array sign, or a generic's last (or first) argument; null if that is no plain word."""
    word = lambda c: F.when(F.trim(c).rlike(r"^\w+$"), F.trim(c))
    inner = F.regexp_extract(raw, r"^[^<\[]*[<\[](.*)[>\]]$", 1)
    tail = F.trim(F.regexp_extract(inner, r"([^,<>\[\]]*)$", 1))
    nested = inner.rlike(r"[>\]]\s*$")
    generic = F.when(~nested, word(tail)) if last else word(_balanced_first(inner))
    return (
        F.when(raw.endswith("[]"), word(F.regexp_replace(raw, r"\[\]$", "")))
        .when(raw.startswith("[]"), word(F.regexp_replace(raw, r"^\[\]", "")))
        .when(inner != "", generic)
    )


def simple_name(raw: Column) -> Column:
    """The simple name of a written type: the base of a generic, the inner type of a nullable wrapper, the last part of a qualified name; null for unions."""
    text = _plain(raw)
    base = F.regexp_extract(text, r"^([\w.:\\]+)\s*<(.+)>$", 1)
    inner = F.regexp_extract(_balanced_first(F.regexp_extract(text, r"^([\w.:\\]+)\s*<(.+)>$", 2)), r"^([\w.:\\]+)", 1)
    name = F.when(base.isin(*NULLABLE), inner).when(base != "", base).otherwise(text)
    return F.when(_last_name(name).rlike(r"^\w+$"), _last_name(name))


def argument_position(container: Column, method: Column) -> Column:
    """Which type argument a container's method yields: the first for keys, else the last; of an unknown container the method's name decides."""
    keys = method.isin(*KEY_METHODS)
    single = "Array List ArrayList LinkedList Vec VecDeque Set HashSet BTreeSet TreeSet Queue Deque Stack Sequence Iterable Iterator IEnumerable IList ICollection Collection ObservableCollection IEnumerator SortedSet Stream MutableList MutableSet LinkedHashSet ArrayDeque PriorityQueue list set tuple frozenset".split()
    return F.when(container.isin(*single), "last").when(keys, "first").otherwise("last")
