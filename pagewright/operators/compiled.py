"""Work that is sequential by its rule, as Java that Spark's own compiler (Janino) compiles: Python takes some fifty times as long for it.

A class is compiled on the driver, written as a jar, and sent to the executors
as any jar of a session; nothing but Spark is needed to build or run it.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType

# The gain of a move is inside / m - total * k / (2 m m). Times 2 m m it is a whole number, and whole numbers that differ
# order the gains as floats do (for less than 2^25 edges). A gain and its community are one number, gain * 2^bits - id * k, whose
# greatest is the best gain and of that the smallest id. It grows with each link to a community, so one loop counts and compares,
# from a base that is above all numbers of the nodes before, so that nothing is cleared. Two gains are equal in whole numbers but
# maybe not as floats only if their totals differ by a multiple of ends / gcd(ends, k); where a total is that large, where a gain
# is 0, and where the numbers have no room, plain() compares floats.
LOUVAIN = """
package pagewright;

public class Louvain implements org.apache.spark.sql.api.java.UDF2 {
    static final long FAR = 1L << 62;

    // the community that a node goes to, by floats
    static int plain(int[] near, int from, int to, int[] at, long[] state, int bits, int[] met, int mine, double m) {
        int k = to - from, go = mine;
        double value = 0.0;
        for (int i = from; i < to; i++) met[at[near[i]] >> 1]++;
        for (int i = from; i < to; i++) {
            int c = at[near[i]];
            double gain = met[c >> 1] / m - (double) ((-state[c] >> bits) * k) / (2 * m * m);
            if (c != mine && (gain > value || (gain == value && go != mine && c < go))) {
                value = gain;
                go = c;
            }
        }
        for (int i = from; i < to; i++) met[at[near[i]] >> 1] = 0;
        return go;
    }

    // at[v] is twice the community c; state[2 c] is -(total * 2^bits + c), state[2 c + 1] the last number of c, state[2 n] the base
    static boolean pass(int[] first, int[] near, int[] at, long[] state, int[] apart, int[] met, int ids, int ends, double m, int bits) {
        boolean moved = false;
        int n = first.length - 1;
        long low = (1L << bits) - 1L, one = (long) ends << bits, out = one + low + 1L, base = state[2 * n], top = 0L;
        for (int c = 0; c < ids; c++) top = Math.max(top, -state[2 * c]);
        for (int v = 0, from = 0; v < n; v++) {
            int to = first[v + 1], mine = at[v], go = mine, k = to - from;
            long own = state[mine] + ((long) k << bits), best = 0L;
            base += k * out;
            if (base > FAR) {
                for (int c = 0; c < n; c++) state[2 * c + 1] = 0L;
                base = k * out;
            }
            state[mine] = -out; // below 0 with any links
            for (int i = from; i < to; i++) {
                int c = at[near[i]];
                long x = Math.max(state[c + 1], state[c] * k + base) + one;
                state[c + 1] = x;
                best = Math.max(best, x);
            }
            state[mine] = own;
            best -= base;
            if (best > 0L && top < (long) apart[v] << bits) {
                go = (int) (-best & low) / k << 1;
            } else if (best > -low - 1L) {
                go = plain(near, from, to, at, state, bits, met, mine, m);
            }
            base += k * one;
            long all = state[go] - ((long) k << bits);
            state[go] = all;
            top = Math.max(top, -all);
            at[v] = go;
            moved |= go != mine;
            from = to;
        }
        state[2 * n] = base;
        return moved;
    }

    static boolean plainPass(int[] first, int[] near, int[] at, long[] state, int[] met, double m) {
        boolean moved = false;
        for (int v = 0; v < first.length - 1; v++) {
            int mine = at[v], k = first[v + 1] - first[v];
            state[mine] += k;
            int go = plain(near, first[v], first[v + 1], at, state, 0, met, mine, m);
            state[go] -= k;
            at[v] = go;
            moved |= go != mine;
        }
        return moved;
    }

    // communities numbered anew in their order, so that those left lie together; ties go by that order. Returns how many are left
    static int renumber(int[] at, long[] state, boolean roomy) {
        int n = at.length;
        int[] id = new int[n];
        long[] old = (long[]) state.clone();
        for (int v = 0; v < n; v++) id[at[v] >> 1] = 1;
        int ids = 0;
        for (int c = 0; c < n; c++) {
            state[2 * c] = roomy ? -c : 0L;
            if (id[c] > 0) {
                state[2 * ids] = old[2 * c] + (roomy ? c - ids : 0);
                id[c] = ids++;
            }
        }
        for (int v = 0; v < n; v++) at[v] = id[at[v] >> 1] << 1;
        return ids;
    }

    // n nodes and links of two of them (a * 2^32 + b), each once: the community of each node, null for a node without links
    public Object call(Object size, Object links) {
        int n = ((Integer) size).intValue();
        scala.collection.Seq pairs = (scala.collection.Seq) links;
        int[] first = new int[n + 1];
        int count = pairs.size();
        long[] pair = new long[count];
        for (int i = 0; i < count; i++) {
            pair[i] = ((Long) pairs.apply(i)).longValue();
            first[(int) (pair[i] >> 32) + 1]++;
            first[(int) pair[i] + 1]++;
        }
        int widest = 0;
        for (int v = 0; v < n; v++) {
            widest = Math.max(widest, first[v + 1]);
            first[v + 1] += first[v];
        }
        int[] next = (int[]) first.clone(), near = new int[2 * count];
        for (int i = 0; i < count; i++) {
            int a = (int) (pair[i] >> 32), b = (int) pair[i];
            near[next[a]++] = b;
            near[next[b]++] = a;
        }
        int ends = 2 * count, bits = 64 - Long.numberOfLeadingZeros((long) n * widest), ids = n;
        boolean roomy = bits < 32 && 2.0 * widest * (ends + 2.0) * (1L << bits) < FAR;
        if (!roomy) bits = 0;
        int[] at = new int[n], met = new int[n], apart = new int[n];
        long[] state = new long[2 * n + 1];
        for (int v = 0; v < n; v++) {
            int k = first[v + 1] - first[v], g = ends, rest = k;
            while (rest > 0) {
                int r = g % rest;
                g = rest;
                rest = r;
            }
            at[v] = 2 * v;
            state[2 * v] = -((long) k << bits) - (roomy ? v : 0);
            apart[v] = k > 0 && k / g <= k - 2 ? ends / g : ends + 1; // two communities have k links at most, so their counts differ by k - 2
        }
        // passes that come back to where they were go round until the last: whole rounds are left out
        int[] held = (int[]) at.clone();
        long since = 0L, hold = 1L, last = 10L * n + 100L;
        for (long done = 1L; done <= last; done++) {
            if (!(roomy ? pass(first, near, at, state, apart, met, ids, ends, (double) count, bits) : plainPass(first, near, at, state, met, (double) count))) break;
            if (java.util.Arrays.equals(at, held)) last = done + (last - done) % (done - since);
            if (done == hold) {
                ids = renumber(at, state, roomy);
                held = (int[]) at.clone();
                since = done;
                hold = 2L * done;
            }
        }
        int[] id = new int[n];
        java.util.Arrays.fill(id, -1);
        ids = 0;
        Integer[] out = new Integer[n];
        for (int v = 0; v < n; v++) {
            if (first[v + 1] == first[v]) continue;
            int c = at[v] >> 1;
            if (id[c] < 0) id[c] = ids++;
            out[v] = Integer.valueOf(id[c]);
        }
        return out;
    }
}
"""


def java_function(spark: SparkSession, source: str, name: str, returns: DataType) -> Callable[..., Column]:
    """A class of UDFn, from its source, as a function of columns."""
    registered = name.replace(".", "_")
    if not spark.catalog.functionExists(registered):
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        made = compiler.getBytecodes()
        handle, jar = tempfile.mkstemp(suffix=".jar", prefix=f"{registered}-")
        with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
            for part in made:
                z.writestr(part.replace(".", "/") + ".class", bytes(made[part]))
        spark.sql(f"ADD JAR '{jar}'")
        # Janino leaves out the type arguments of the interface, without which a class can't be registered by its name
        loader = spark._jsparkSession.artifactManager().classloader()
        function = loader.loadClass(name).getDeclaredConstructor(spark._sc._gateway.new_array(spark._jvm.java.lang.Class, 0)).newInstance(spark._sc._gateway.new_array(spark._jvm.java.lang.Object, 0))
        spark._jsparkSession.udf().register(registered, function, spark._jsparkSession.parseDataType(returns.json()))
    return lambda *columns: F.call_function(registered, *columns)


def louvain(spark: SparkSession, nodes: Column, links: Column) -> Column:
    return java_function(spark, LOUVAIN, "pagewright.Louvain", ArrayType(IntegerType()))(nodes, links)
